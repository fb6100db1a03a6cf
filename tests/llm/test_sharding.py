import hashlib

import pytest

from claimlens.llm import sharding


def assign_by_hand(rows, limit):
    """Extendible hashing one row at a time: split a bucket while it is over the limit."""
    def h(i, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return bin(int(hashlib.md5(f"{'' if i is None else i}:{inner}".encode()).hexdigest()[:15], 16))[2:].zfill(60)

    items = [(h(i, t), len((t or "").encode()), i) for i, t in rows]
    out, todo = [], [("", items)]
    while todo:
        p, bucket = todo.pop()
        if sum(n for _, n, _ in bucket) <= limit or len({x for x, _, _ in bucket}) == 1:
            out += [(i, n, p) for _, n, i in bucket]
        else:
            for bit in "01":
                if part := [x for x in bucket if x[0].startswith(p + bit)]:
                    todo.append((p + bit, part))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [10, 300, 5_000, 10**9])
def test_equals_splitting_by_hand(spark, limit):
    rows = [(i, "x" * (i * 7 % 90)) for i in range(400)] + [(7, "same")] * 9 + [(None, None), (1, ""), (2, "é" * 4_000)]
    df = spark.createDataFrame([(i, t, "c", 3) for i, t in rows], "doc_id long, text string, shard string, depth int")
    got = sharding.assign_shards(df, "doc_id", "text", limit).collect()
    assert sorted([(r.doc_id, r.n_bytes, r.shard) for r in got], key=str) == assign_by_hand(rows, limit)
    sums = {}
    for r in got:
        sums[r.shard] = sums.get(r.shard, 0) + r.n_bytes
        assert r.depth == len(r.shard)
    assert all(sums[r.shard] == r.shard_bytes and r.oversized == (r.shard_bytes > limit) for r in got)


def test_rounds_go_on_below_the_first_bits(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    rows = [(i, "y" * 40) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    slim = df.select("doc_id", sharding.key_hash(sharding.F.col("doc_id")).alias("h"), sharding.F.lit(40).cast("long").alias("n_bytes"))
    rounds = sharding.directory_cells(slim, 100, first_bits=3)
    assert len(rounds) > 1 and sum(t.count() for _, t in rounds[:1]) < 8


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(df, "doc_id", "text", 10).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame([(i, "z" * i) for i in range(60)], "doc_id long, text string")
    assigned = sharding.assign_shards(df, "doc_id", "text", 200)
    sharding.write_shards(df, assigned, "doc_id", str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 60
    assert max(r.b for r in back.groupBy("shard_bits").agg(sharding.F.sum(sharding.F.length("text")).alias("b")).collect()) <= 200
