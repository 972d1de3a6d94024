from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from curatrix.llm.exactdedup import LOWER, UPPER, Deduplication

SCHEMA = "doc_id long, text string, digest string, place string, n long"
ROWS = [
    (1, "Same Text"), (2, "same text"), (9, "SAME TEXT"), (3, None), (4, ""), (5, "Éa"), (6, "éa"), (7, "ÉA"),
    (8, "x" * 300_000 + "A"), (10, "x" * 300_000 + "a"), (None, "nobody"), (None, "Nobody"), (11, "twice"), (11, "twice"), (12, " same text"),
]


def expected(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(str.maketrans(UPPER, LOWER))].append(i)
    return sorted(
        ((i, max(ids, key=lambda x: (x is not None, x)), len(ids), hashlib.sha256(text.encode()).hexdigest()) for text, ids in groups.items() for i in ids),
        key=str,
    )


def found(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=str)


def table(spark, path, rows, mode="overwrite", files=1):
    spark.createDataFrame([(i, t, "d", "p", 1) for i, t in rows], SCHEMA).repartition(files).write.mode(mode).parquet(path)


def checked(rows, df):
    df = df.cache()
    assert found(df) == expected(rows)
    kept = [r for r in df.where("kept").collect()]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({e[3] for e in expected(rows)})
    assert all(r.id == r.keep_id for r in kept)
    df.unpersist()


def test_groups_equal_brute_force_over_batches_and_later_files(spark, tmp_path):
    path = f"{tmp_path}/docs"
    table(spark, path, ROWS, files=4)
    work = Deduplication(spark, f"{tmp_path}/work")
    work.take_up(path, files=2)
    checked(ROWS, work.decisions(path))
    more = [(20, "SAME text"), (0, "twice"), (21, "new")]
    table(spark, path, more, mode="append")
    again = Deduplication(spark, f"{tmp_path}/work")  # another run over the stored state
    again.take_up(path)
    assert {r.batch for r in spark.read.parquet(f"{tmp_path}/work/changed").select("batch").collect()} >= {0, 1, 2}
    assert spark.read.parquet(f"{tmp_path}/work/changed").where("batch >= 2").count() == 3, "only the groups that changed"
    checked(ROWS + more, again.decisions(path))


def test_texts_that_share_a_digest_are_told_apart_by_their_bytes(spark, tmp_path):
    path = f"{tmp_path}/docs"
    rows = [*ROWS, *((100 + k, f"text {k % 7}") for k in range(40))]
    table(spark, path, rows, files=3)
    work = Deduplication(spark, f"{tmp_path}/work", digest=lambda text: F.encode(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 1), "UTF-8"))
    work.take_up(path)
    checked(rows, work.decisions(path))


def test_empty_table(spark, tmp_path):
    path = f"{tmp_path}/docs"
    table(spark, path, [])
    work = Deduplication(spark, f"{tmp_path}/work")
    work.take_up(path)
    out = work.decisions(path)
    assert out.count() == 0 and out.columns == ["id", "keep_id", "group_size", "kept", "text_sha256"]
