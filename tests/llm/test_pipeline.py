from __future__ import annotations

import os
from collections import Counter

import public_tokenizers
import pyarrow as pa
import tiktoken

import corpus_pipeline
from assayer.llm import queries
from assayer.llm.bpe import load_ranks
from assayer.llm.exact_dedup import normalise
from assayer.llm.shared import BATCH, packed, repeated, stored
from assayer.sources.tables import shared_dir
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_mixing import shared_out

SF = "/root/testdata/sf0.001"


def plain_near(rows):
    """Ids that stay when documents linked by similar sets form groups."""
    sets = {r.doc_id: shingle_set(r.text, corpus_pipeline.NEAR_WORDS) for r in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= corpus_pipeline.NEAR_PERCENT * (len(sets[i]) + len(sets[j]) - common):
                    a, b = sorted((root(i), root(j)))
                    parent[b] = a
    return {i for i in sets if root(i) == i}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(-1, None, "en", "src0", 0), (-2, "", None, None, 0), (-3, "1234 ...", "en", "src0", 8), (-4, "Odd One", "en", None, 7),
         (-5, "oDD one", None, None, 7), (None, "no id", "en", None, 5), (None, "NO id", "en", None, 5)], docs.schema)
    tables = [stored(docs.unionByName(odd), "raw")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, tables[-1], SF)
        if name != "bpe":
            assert out.columns == docs.columns
        tables.append(stored(out, name))
    raw, known, single, apart, mix, ids = [t.collect() for t in tables]
    assert {r.doc_id for r in raw} - {r.doc_id for r in known} == {-1, -2, -3}
    last = {}
    for r in known:
        key = normalise(r.text)
        last[key] = r.doc_id if last.get(key) is None else max(last[key], r.doc_id or last[key])
    assert sorted(map(repr, (r.doc_id for r in single))) == sorted(map(repr, last.values()))
    assert {r.doc_id for r in apart} - {None} == plain_near([r for r in single if r.doc_id is not None])
    copies = Counter(r.doc_id for r in mix)
    sizes, biggest, taken = {}, {}, Counter()
    for r in apart:
        n = len(normalise(r.text).split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        biggest[r.source] = max(biggest.get(r.source, 0), n)
        taken[r.source] += n * copies[r.doc_id]
        assert copies[r.doc_id] <= 3
    for source, target in shared_out(sizes).items():
        assert abs(taken[source] - target) <= 2 * biggest[source]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                 mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    assert Counter((r.doc_id, r.n_tokens) for r in ids) == Counter(
        (r.doc_id, len(encoding.encode_ordinary(r.text))) for r in mix)


def test_empty_table(spark):
    docs = stored(spark.read.parquet(f"{SF}/documents.parquet").limit(0), "none")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_extra_columns_stay(spark):
    extra = ["row", "copies", "doc", "kept", "group", "size", "n", "class"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    docs = stored(docs.selectExpr("*", *[f"doc_id AS {x}" for x in extra]), "extra")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns[-len(extra):] == extra and docs.where("row <> doc_id OR copies <> doc_id").isEmpty()


def numbers_under_other_splits(spark, df, columns):
    found = []
    for most in ("128m", "4k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        found.append({(r[0], r[1]) for r in df.selectExpr(*columns).collect()})
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    return found


def test_numbers_stay_when_files_are_split_otherwise(spark, monkeypatch):
    docs = stored(spark.range(20_000).selectExpr("id AS doc_id", "sha2(string(id), 256) AS text").coalesce(1), "docs")
    spark.conf.set("parquet.block.size", "4096")
    many = stored(docs.repartition(3), "docs")
    spark.conf.unset("parquet.block.size")
    first, second = numbers_under_other_splits(spark, packed(many), ("row", "doc.doc_id"))
    assert first == second and len({r for r, _ in first}) == 20_000
    seen = []
    monkeypatch.setattr(queries, "table", lambda *_: many)
    monkeypatch.setattr(queries.jaccard, "components", lambda df, *_: seen.append(df) or df.withColumn("group", df.row))
    queries.QUERIES["op4_jaccard_orders"](spark, SF)
    first, second = numbers_under_other_splits(spark, seen[0], ("row", "doc_id"))
    assert first == second


def test_stages_hand_python_few_documents_at_a_time(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    before = spark.conf.get(BATCH)
    sent = stored(spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "n long"), "sizes", batch=corpus_pipeline.BATCH_ROWS)
    assert [r.n for r in sent.collect()] == [corpus_pipeline.BATCH_ROWS] * 5 and spark.conf.get(BATCH) == before


def test_documents_are_not_shuffled_to_their_counts(spark):
    docs = stored(spark.range(10_000).selectExpr("id AS doc_id", "repeat(string(id), 50) AS text").repartition(3), "docs")
    rows = packed(docs)
    counts = stored(rows.selectExpr("row", "doc.doc_id", "cast(doc.doc_id % 4 AS int) AS copies"), "counts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few, many = repeated(rows, counts), repeated(rows, counts, most_blocks=0)
        assert "Exchange hash" not in few._jdf.queryExecution().executedPlan().toString()
        for out in (few, many):
            assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter({i: i % 4 for i in range(10_000) if i % 4})
            assert out.columns == docs.columns and out.where("text <> repeat(string(doc_id), 50)").isEmpty()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_join_leaves_two_small_tables(spark):
    rows = packed(spark.read.parquet(f"{SF}/documents.parquet"))
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = corpus_pipeline.jaccard.components(rows.select("row", "doc.doc_id", "doc.text"), 5, 80)
    assert sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before) == ["llm-rows", "llm-smallest"]
    assert found.count() == rows.count()


def test_no_stage_leaves_python_work_to_the_writer(spark):
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), spark.conf.get(BATCH)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert "InArrow" not in out._jdf.queryExecution().optimizedPlan().toString(), name
        docs = stored(out, name)
    assert spark.conf.get(BATCH) == before


def test_stages_themselves_hand_python_few_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BATCH_ROWS", 7)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plain = type(docs).mapInArrow

    def watched(self, work, *a, folder=str(tmp_path)):
        def seen(batches):
            import os
            import uuid

            def noted():
                for b in batches:
                    if "text" in b.schema.names:
                        open(os.path.join(folder, f"{b.num_rows}-{uuid.uuid4().hex}"), "w").close()
                    yield b
            return work(noted())
        return plain(self, seen, *a)

    monkeypatch.setattr(type(docs), "mapInArrow", watched)
    for name, stage in corpus_pipeline.STAGES:
        before = set(os.listdir(tmp_path))
        out = stored(stage(spark, docs, SF), name)
        sizes = {int(x.split("-")[0]) for x in set(os.listdir(tmp_path)) - before}
        assert name == "mix_sources" or sizes and max(sizes) == 7, name
        docs = out
