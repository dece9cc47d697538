import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_and_registration(spark):
    assert [n for n, _ in P.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and set(ids) <= before, name
        if name != "source_mixing":
            assert len(ids) == len(set(ids)), name
        before = set(ids)
    assert len(before) > 100
    packed = P.STAGES[-1][1](spark, docs, SF)
    assert packed.where("offset + length > 2048").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == before


def test_near_copy_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(3, text), (9, text), (5, text.replace("word77", "other")), (7, "quite another text of its own"), (1, None), (2, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in P.drop_near_copies(spark, docs, SF).collect())
    assert got == [1, 3, 7]


def test_passage_stage_updates_n_chars(spark):
    passage = " ".join(f"shared{k}" for k in range(90))
    rows = [(1, "first own words " + passage), (2, "second has these " + passage + " and an end"), (3, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.drop_repeated_passages(spark, docs, SF).collect()}
    assert got[1].text == rows[0][1] and all(r.n_chars == len(r.text) for r in got.values())
    assert len(got[2].text) < 250 and got[2].text.startswith("second has")


def test_language_stage_drops_what_it_rejects(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, "12345 !!", "en", "s", 8), (-2, None, None, "s", 0)], docs.schema)
    got = P.identify_language(spark, docs.union(odd), SF)
    ids = {r.doc_id for r in got.select("doc_id").collect()}
    assert not ids & {-1, -2} and len(ids) > 0.97 * docs.count()


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, copies int, cut string, component string, `key` long"


def odd_rows(spark):
    base = " ".join(f"some{k} words{k % 7} of prose" for k in range(60))
    long = " ".join(f"w{k % 997}" for k in range(200_000))
    rows = [(1, base), (1, base), (2, base), (3, None), (4, ""), (None, "quite another text with a null id"), (None, None), (5, long), (6, "tie one two three four five six"), (6, "tie another text of the same id")]
    full = [(i, t, "en", "s", len(t or ""), "r", 1, "c", "d", 9) for i, t in rows]
    return spark.createDataFrame([*full, (8, "all else is null here", *[None] * 8)], ODD)


def test_stages_on_odd_rows(spark):
    docs = odd_rows(spark)
    for name, stage in P.STAGES:
        got = stage(spark, docs, SF)
        rows = got.collect()
        if name != "best_fit_packing":
            assert got.columns == docs.columns, name
            assert all((r.row, r["key"]) == (("r", 9) if r.doc_id != 8 else (None, None)) for r in rows), name
        empty = stage(spark, docs.limit(0), SF)
        assert empty.collect() == [] and empty.columns == got.columns, name
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        if name == "language_id":
            assert not {3, 4} & set(ids)
        elif name == "simhash_near_dedup":
            assert ids == [1, 3, 5, 6, 6, 8] and len(rows) == 7
        elif name == "substring_dedup":
            assert ids == [1, 1, 3, 4, 5, 6, 6, 8]
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        elif name == "best_fit_packing":
            assert sum(r.piece == 0 for r in rows) == docs.count() and max(r.offset + r.length for r in rows) <= 2048


def test_mixing_stage_lowers_the_bad_share(spark):
    """Documents and labels of one folder; unlabelled documents are there as well."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    share = lambda d: d.join(labels, "doc_id").agg(F.avg(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int"))).first()[0]
    mixed = P.mix_sources(spark, docs, folder)
    assert share(mixed) < share(docs)
    assert mixed.select("doc_id").distinct().join(docs, "doc_id").count() == mixed.select("doc_id").distinct().count()


def test_packing_stage_holds_every_token_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = P.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in rows if r.piece == 0} == {r.doc_id for r in docs.select("doc_id").collect()}
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_mixing_stage_with_the_labels_of_its_texts(spark):
    """Documents and labels of one folder: clean documents stay, most of the others go."""
    from pyspark.sql import functions as F

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels, "doc_id", "semi")
    bad = F.expr("toxic = 1 or quality = 0")
    kept = P.mix_sources(spark, docs, folder).select("doc_id").distinct().join(labels, "doc_id")
    assert kept.where(~bad).count() > 0.95 * labels.where(~bad).count()
    assert kept.where(bad).count() < 0.5 * labels.where(bad).count()
