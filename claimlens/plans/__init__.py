"""Report, view, presentation and data-quality plans over the claims model."""
