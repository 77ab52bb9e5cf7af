import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import constants as C
from lodestone import catalog, schemas
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import bm25, checks, corpus, diffs, embedding, evaluation, overlap, ranking, rows, vector_signal
from lodestone.plans import samples
from lodestone.sources import snapshot, store


def ts(spark, days):
    return F.timestamp_seconds((days * 86_400).cast("long"))


def test_hunks(spark):
    d = spark.createDataFrame(samples.DIFFS, "number long, diff string")
    h = {}
    for r in diffs.parse_hunks(d).orderBy("number", "block_no", "hunk_index").collect():
        h.setdefault(r.number, []).append((r.file_path, r.hunk_index, r.additions, r.deletions))
    assert h[1] == [("lib/util.py", 0, 1, 0)]
    assert h[2] == [("lib/util.py", 0, 1, 0), ("lib/util.py", 1, 1, 1), ("lib/util.py", 2, 0, 2)]
    assert len(h[3]) == 1 and h[9] == [("src/my file.js", 0, 1, 1)]
    assert not {4, 5, 6, 8} & set(h) and [x[0] for x in h[7]] == ["ci/a.yml"]
    first = diffs.parse_hunks(d.filter("number = 1")).first().content
    assert first == "def run():\n a\n+b\n c"


def test_line_ends_of_any_kind(spark):
    body = "diff --git a/a.py b/a.py\n+++ b/a.py\n@@ -1 +1,2 @@\r\n+one\r\n+two +three\n-x\n"
    r = diffs.parse_hunks(spark.createDataFrame([(1, body)], "number long, diff string")).first()
    assert (r.additions, r.deletions) == (3, 1)


def test_diff_kinds(spark):
    d = spark.createDataFrame(samples.DIFFS, "number long, diff string")
    kinds = {r.number: r.kind for r in d.select("number", diffs.classify(F.col("diff")).alias("kind")).collect()}
    assert kinds == {1: "simple_single_file", 2: "multi_file", 3: "at_marker_in_content", 4: "deleted_file", 5: "rename_only", 6: None, 7: "binary_file", 8: "simple_single_file", 9: "simple_single_file", 10: "multi_file"}


def group(spark, data):
    df = spark.createDataFrame(data, "number long, author string, title string, day double, merged boolean")
    df = df.select("number", "author", F.lit("User").alias("author_type"), "title", ts(spark, F.col("day")).alias("created_at"), F.when(F.col("merged"), ts(spark, F.col("day"))).alias("merged_at"))
    return df


def test_duplicates_are_anchored_at_the_first(spark):
    days = [0, 3, 7, 7 + 1 / 86_400, 9, 15, 16]
    df = group(spark, [(k, "a", "T", float(d), False) for k, d in enumerate(days)])
    got = {r.number: r.anchor for r in corpus.group_duplicates(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5} or got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5}


def test_keepers_and_the_guard(spark):
    df = group(spark, [(1, "a", "T", 0.0, False), (2, "a", "t.", 1.0, True), (3, "a", " T ", 2.0, False), (4, "b", "T", 0.0, True), (5, "b", "T", 1.0, True), (6, "dependabot[bot]", "T", 0.0, False), (7, "c", "(x) update stewards.yml", 0.0, False), (8, "A", "T", 0.5, False)])
    v = {r.number: r.exclusion_reason for r in corpus.verdicts(df).collect()}
    assert v == {1: C.REASON_DUPLICATE, 2: None, 3: C.REASON_DUPLICATE, 4: None, 5: None, 6: C.REASON_BOT, 7: C.REASON_HOUSEKEEPING, 8: None}


def test_ascending_breaks(spark):
    df = group(spark, [(n, "a", "T", d, False) for n, d in ((1, 0.0), (2, 0.1), (9, 1.0), (4, 1.5), (5, 4.0), (5, 9.0))])
    assert sorted(map(tuple, corpus.ascending_breaks(df).collect())) == [(4, 9), (5, 5)]


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=30))
@settings(deadline=None, max_examples=10)
def test_grouping_equals_the_greedy_rule(spark, changes):
    rows_ = [(k, a, "T", float(d), False) for k, (a, d) in enumerate(changes)]
    got = {r.number: r.anchor for r in corpus.group_duplicates(group(spark, rows_)).collect()}
    want, open_ = {}, {}
    for n, a, _, d, _ in sorted(rows_, key=lambda r: (r[3], r[0])):
        anchor = open_.get(a)
        if anchor is None or d - anchor[1] > 7:
            anchor = open_[a] = (n, d)
        want[n] = anchor[0]
    assert got == want


def test_titles_and_tokens(spark):
    df = spark.createDataFrame([("  Fix the  Bug . ",), ("parseHTTPResponse p5 snake_case",)], "s string")
    a, b = df.select(T.normalize_title(F.col("s")).alias("n"), T.tokenize(F.col("s")).alias("t")).collect()
    assert a.n == "fix the bug"
    assert b.t == ["parsehttpresponse", "parse", "http", "response", "p5", "p", "5", "snake_case", "snake", "case"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0], ["a", "b"], ["b", "c"], [])], "x array<double>, y array<double>, p array<string>, q array<string>, e array<string>")
    r = df.select(V.cosine(F.col("x"), F.col("y")).alias("c"), V.jaccard(F.col("p"), F.col("q")).alias("j"), V.jaccard(F.col("p"), F.col("e")).alias("z"), V.top_mean(F.array(*map(F.lit, (1.0, 4.0, 2.0, 3.0))), 3).alias("m")).first()
    assert (r.c, round(r.j, 6), r.z, r.m) == (0, 0.333333, 0, 3)


def chunk_frames(spark):
    chunks = spark.createDataFrame([(k, 1, k, True, [float(k), 1.0]) for k in range(1, 9)] + [(20, 2, 1, True, [1.0, 1.0]), (21, 1, 1, False, [1.0, 1.0]), (22, 1, 2, True, None)], "pr_id long, repo_id int, day int, in_corpus boolean, embedding array<double>")
    chunks = chunks.withColumn("created_at", ts(spark, F.col("day")))
    query = chunks.filter("pr_id in (4, 8)").select(F.col("pr_id").alias("query_pr"), F.col("pr_id").alias("query_chunk"), "repo_id", "created_at", "embedding")
    return query, chunks


def test_vector_signal_is_strictly_earlier(spark):
    query, chunks = chunk_frames(spark)
    got = vector_signal.signal(query, chunks, dim=2).collect()
    assert {(r.query_pr, r.pr_id) for r in got} == {(4, k) for k in (1, 2, 3)} | {(8, k) for k in range(1, 8)}
    with pytest.raises(ValueError):
        vector_signal.aggregate(query, "median")
    with pytest.raises(Exception, match="dimension"):
        vector_signal.signal(query, chunks, dim=3).collect()


def test_cut_comes_after_the_filter(spark):
    query, chunks = chunk_frames(spark)
    assert vector_signal.signal(query.filter("query_pr = 4"), chunks, dim=2, k=3).count() == 3


def test_overlap(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 2, ["b", "c", "c"]), (3, 3, ["x"]), (4, 4, []), (5, 9, ["b"])], "pr_id long, day int, files array<string>")
    df = df.select("pr_id", F.lit(1).alias("repo_id"), ts(spark, F.col("day")).alias("created_at"), F.lit(True).alias("in_corpus"), "files")
    got = overlap.overlap_join(df.filter("pr_id = 5").withColumnRenamed("pr_id", "query_pr"), df).collect()
    assert [(r.pr_id, r.shared, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 0.5, 1), (2, 1, 0.5, 2)]


def test_bm25_floor_repeats_and_time(spark):
    docs = spark.createDataFrame([(k, f"common word{k} pad" + (" rare" if k in (3, 7) else "")) for k in range(20)], "pr_id long, text string")
    index = bm25.build(docs)
    idf = {r.term: r.idf for r in index.idf.collect()}
    average = index.stats.first().average_idf
    assert idf["common"] == pytest.approx(0.25 * average)
    q = spark.createDataFrame([(100, "rare"), (101, "rare rare")], "query_pr long, text string").withColumn("created_at", ts(spark, F.lit(5)))
    s = {(r.query_pr, r.pr_id): r.score for r in bm25.scores(index, q).collect()}
    assert s[101, 3] == pytest.approx(2 * s[100, 3], abs=1e-5)
    at = docs.select("pr_id", ts(spark, F.col("pr_id")).alias("created_at"))
    assert {(r.query_pr, r.pr_id) for r in bm25.signal(index, q, at).collect()} == {(100, 3), (101, 3)}


def test_ranking_and_reasons(spark):
    raw = spark.createDataFrame([(1, 10, 0.9, 0.5, 3.0), (1, 11, 0.1, 0.5, 3.0), (1, 12, 0.5, 0.5, 1.0)], "query_pr long, pr_id long, vector double, file double, bm25 double")
    r = ranking.rank(ranking.normalise(raw)).orderBy("rank").collect()
    assert [(x.pr_id, x.final_score, x.file_norm) for x in r] == [(10, 0.7, 0.0), (12, 0.25, 0.0), (11, 0.2, 0.0)]
    with pytest.raises(ValueError):
        ranking.rank(ranking.normalise(raw), weights=(0.5, 0.5, 0.5))
    cases = spark.createDataFrame([("a/b.py", 0.9, 0.0, "merged"), ("a/b.py", 0.1, 0.0, "closed_unmerged"), (None, 0.9, 0.0, "open"), (None, 0.1, 0.9, "merged"), (None, 0.1, 0.1, "merged")], "shared_file string, vector_norm double, bm25_norm double, outcome string")
    said = [x.reason for x in ranking.reasons(cases.withColumn("top_file", F.lit("src/x.py")).withColumn("top_terms", F.array(F.lit("t"), F.lit("u"), F.lit("v")))).collect()]
    assert said == ["Both modify a/b.py with a similar change pattern", "Also changes a/b.py" + C.CLOSED_SUFFIX, "Similar change pattern in src/x.py", "Shares terminology: t, u", "Related change in src"]


def test_evaluation(spark):
    res = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 4), (2, 20, 3)], "query_pr long, pr_id long, rank int")
    jud = spark.createDataFrame([(1, 11, 2), (1, 12, 2), (1, 10, 0), (2, 21, 2), (3, 1, 1)], "query_pr long, pr_id long, grade int")
    assert {(r.query_pr, r.recall) for r in evaluation.recall_at(res, jud).collect()} == {(1, 0.5), (2, 0.0)}
    assert {(r.query_pr, r.rr) for r in evaluation.reciprocal_rank(res, jud).collect()} == {(1, 0.5), (2, 0.0)}
    same = spark.createDataFrame([(q, q, r, q % 3) for q in range(12) for r in (1, 2)], "query_pr long, pr_id long, round int, grade int")
    assert evaluation.weighted_kappa(same).first() == (12, 1.0)
    assert evaluation.weighted_kappa(same.filter("query_pr < 5")).first().kappa is None
    ci = evaluation.bootstrap(spark.createDataFrame([(k, float(k % 2)) for k in range(20)], "query_pr long, rr double"), "rr").first()
    assert ci.low < ci.mid < ci.high


def test_rows_and_missing_diffs(spark):
    items = rows.parse_items(spark.createDataFrame([(r,) for r in samples.ITEMS], "raw string"))
    verdicts = spark.createDataFrame(samples.VERDICTS, "number long, exclusion_reason string")
    d, gone = spark.createDataFrame(samples.DIFFS, "number long, diff string"), spark.createDataFrame([(11,)], "number long")
    got = {r.number: r for r in rows.build(items, verdicts, d, gone).collect()}
    assert {k: r.exclusion_reason for k, r in got.items()} == {1: None, 2: None, 3: C.REASON_BOT, 4: C.REASON_NO_SOURCE, 7: None, 8: C.REASON_NO_SOURCE, 10: C.REASON_HOUSEKEEPING, 11: C.REASON_NO_DIFF}
    assert got[4].author == got[7].author == got[11].author == "ghost" and "base" not in json.loads(got[1].raw) and json.loads(got[1].raw)["head_sha"] == "s1"
    with pytest.raises(Exception, match="no diff for change"):
        rows.build(items, verdicts, d.filter("number <> 2"), gone).collect()
    cut = rows.chunk_rows(spark.createDataFrame([(256,), (257,)], "token_count int")).collect()
    assert [r.was_truncated for r in cut] == [False, True]


def test_store(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k long, frozen string, v string")
    s = spark.createDataFrame([(2, "B", None), (3, "C", "z")], "k long, frozen string, v string")
    assert sorted(map(tuple, store.upsert(t, s, ["k"], ["frozen"]).collect())) == [(1, "a", "x"), (2, "b", None), (3, "C", "z")]
    assert [r.k for r in store.insert_ignore(t, s.unionByName(s), ["k"]).collect()] == [3]
    store.load(t, f"{tmp_path}/out/t", f"{tmp_path}/stage")
    store.load(s, f"{tmp_path}/out/t", f"{tmp_path}/stage")
    assert spark.read.parquet(f"{tmp_path}/out/t").count() == 2
    with pytest.raises(KeyError):
        store.destination({"local": "x"}, "remote")
    ranked = spark.createDataFrame([(1, 2, 20, 0.1, 0.0, 0.0, 0.0), (1, 1, 10, 0.9, 0.0, 0.0, 0.0)], "query_pr long, rank int, pr_id long, final_score double, vector_norm double, file_norm double, bm25_norm double")
    r = store.results_row(ranked, {"vector": 0.5}).first()
    assert [x.pr_id for x in r.results] == [10, 20] and r.weights == {"vector": 0.5}
    c = spark.createDataFrame([(k, k, k != 3) for k in range(6)], "pr_id long, number long, in_corpus boolean")
    assert [r.number for r in store.pending(c, spark.createDataFrame([(0,), (0,)], "pr_id long"), 2).collect()] == [1, 2]
    for schema in schemas.TABLES.values():
        assert store.empty(spark, schema).count() == 0


def test_snapshot(spark, tmp_path):
    for page, numbers in ((1, range(1, 101)), (2, range(101, 131))):
        (tmp_path / f"o__r_page_{page}.json").write_text(json.dumps([{"number": n, "id": n, "title": "t", "user": None, "labels": []} for n in numbers]))
    (tmp_path / "7.diff").write_text("diff --git a b\n")
    (tmp_path / "status.json").write_text('{"diff_unavailable": [5, 6]}')
    pages = snapshot.read_pages(spark, str(tmp_path), "o__r")
    assert pages.count() == 130 and snapshot.trusted_pages(pages).count() == 100
    m = snapshot.freeze(spark, pages, "o__r", "test", f"{tmp_path}/manifest")
    assert (m["pages"], m["total"], m["first"], m["last"]) == (2, 130, 1, 130)
    with pytest.raises(Exception):
        snapshot.freeze(spark, pages, "o__r", "again", f"{tmp_path}/manifest")
    assert snapshot.read_frozen(spark, str(tmp_path), "o__r", snapshot.read_manifest(spark, f"{tmp_path}/manifest")).count() == 130
    with pytest.raises(snapshot.SnapshotError):
        snapshot.read_frozen(spark, str(tmp_path), "o__r", m | {"total": 131})
    assert snapshot.thaw(spark, f"{tmp_path}/manifest") and snapshot.read_manifest(spark, f"{tmp_path}/manifest") is None
    assert rows.meta(snapshot.read_items(spark, str(tmp_path), "o__r")).filter("author = 'ghost'").count() == 130
    assert snapshot.duplicate_numbers(snapshot.read_items(spark, str(tmp_path), "o__r")).count() == 0
    assert [r.number for r in snapshot.read_diffs(spark, f"{tmp_path}/*.diff").collect()] == [7]
    assert sorted(r.number for r in snapshot.read_unavailable(spark, f"{tmp_path}/status.json").collect()) == [5, 6]


def test_paged_source_and_retry(spark):
    spark.dataSource.register(snapshot.PagedSource)
    df = spark.read.format("paged_list").options(fetcher="lodestone.plans.pages:numbers", pages="4", per_page="10", base="0").load()
    assert df.count() == 25
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert snapshot.with_retry(call, sleep=waits.append) == "ok" and waits == [1, 2]
    with pytest.raises(OSError):
        snapshot.with_retry(lambda: (_ for _ in ()).throw(OSError()), attempts=2, sleep=waits.append)


def test_checks(spark):
    v = spark.createDataFrame([(1, True, None), (2, False, "bot_author"), (2, True, "odd")], "number long, in_corpus boolean, exclusion_reason string")
    assert checks.verdicts_sound(v, 3).first() == (True, False, False, False)
    r = checks.violations(v, unique=[["number"]], not_null=["exclusion_reason"]).collect()
    assert {x.rule: x.broken for x in r} == {"unique number": 1, "not null exclusion_reason": 1}
    assert checks.rows_sound(v.withColumn("files_changed", F.array(F.lit("a"))), 3).first().no_files_if_excluded is False


def test_vector_guards(spark):
    query, chunks = chunk_frames(spark)
    vector_signal.check(query, chunks)
    with pytest.raises(ValueError, match="no chunks"):
        vector_signal.check(query.filter("false"), chunks)
    with pytest.raises(ValueError, match="corpus has no chunks"):
        vector_signal.check(query, chunks.filter("embedding is null"))
    with pytest.raises(ValueError, match="time zone"):
        vector_signal.check(query.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")), chunks)


def test_vector_blocks_cut_and_best_chunk_equal_plain_loops(spark, monkeypatch):
    """Query blocks, the cut inside a task and ties against a loop over all pairs."""
    import random

    monkeypatch.setattr(vector_signal, "QUERY_BLOCK", 4)
    rng = random.Random(3)
    data = [(k // 3, k % 2, k, k // 3, [float(rng.choice((1, 2, 3))) for _ in range(3)]) for k in range(120)]
    df = spark.createDataFrame(data, "pr_id long, repo_id int, chunk long, day int, embedding array<double>").withColumn("created_at", ts(spark, F.col("day"))).withColumn("in_corpus", F.lit(True)).repartition(5)
    q = df.filter("pr_id % 10 = 9").select(F.col("pr_id").alias("query_pr"), F.col("chunk").alias("query_chunk"), "repo_id", "created_at", "embedding")
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    want = {}
    for pr, repo, chunk, _, v in data:
        if pr % 10 == 9:
            best = {}
            for other, r, c, _, w in data:
                if r == repo and other < pr:
                    s = (round(sum(a * b for a, b in zip(unit(v), unit(w))), 6), -c)
                    best[other] = max(best.get(other, s), s)
            want.update({(chunk, o): x for o, x in sorted(best.items(), key=lambda e: (-e[1][0], e[0]))})
    got = {(r.query_chunk, r.pr_id): (round(r.score, 6), -r.best_chunk) for r in vector_signal.chunk_scores(q, df, dim=3).collect()}
    assert got == want
    for k in (1, 4):
        top = {}
        for (c, o), x in want.items():
            top.setdefault(c, []).append((-x[0], o))
        cut = {(c, o) for c, v in top.items() for _, o in sorted(v)[:k]}
        best = vector_signal.top_per(vector_signal.chunk_scores(q, df, dim=3, k=k), ["query_pr", "query_chunk"], k)
        assert {(r.query_chunk, r.pr_id) for r in best.collect()} == cut


def test_best_changes_and_pair_scores_equal_all_pairs(spark, monkeypatch):
    """Small blocks, slices and buffers; a task sends on k changes of a query at most."""
    import random

    for name, size in (("QUERY_BLOCK", 7), ("CELLS", 30), ("KEPT_ROWS", 1)):
        monkeypatch.setattr(vector_signal, name, size)
    rng = random.Random(5)
    data = [(k // 3, k % 2, k, k // 3, [float(rng.choice((1, 2, 3))) for _ in range(3)]) for k in range(150)]
    df = spark.createDataFrame(data, "pr_id long, repo_id int, chunk long, day int, embedding array<double>").withColumn("created_at", ts(spark, F.col("day"))).withColumn("in_corpus", F.lit(True)).repartition(5)
    q = df.filter("pr_id % 10 = 9").select(F.col("pr_id").alias("query_pr"), F.col("chunk").alias("query_chunk"), "repo_id", "created_at", "embedding")
    whole = {(r.query_pr, r.pr_id): (r.score, r.best_chunk) for r in vector_signal.aggregate(vector_signal.chunk_scores(q, df, dim=3)).collect()}
    for k in (1, 4):
        order = sorted(whole, key=lambda x: (x[0], -whole[x][0], x[1]))
        want = {x for n, x in enumerate(order) if sum(y[0] == x[0] for y in order[:n]) < k}
        assert {(r.query_pr, r.pr_id) for r in vector_signal.best_changes(q, df, k, dim=3).collect()} == want
        left, right = vector_signal._sides(q, df)
        sent = vector_signal._best_of(next(vector_signal._blocks(left)), right.coalesce(1), 3, 6, k, "query_pr")
        assert all(r["count"] <= k for r in sent.groupBy("query_pr").count().collect())
    some = spark.createDataFrame([*[x for x in whole if sum(x) % 2], (9, 9), (9, 30), (-5, 2)], "query_pr long, pr_id long")
    got = {(r.query_pr, r.pr_id): (r.score, r.best_chunk) for r in vector_signal.pair_scores(some, q, df, dim=3).collect()}
    assert got == {x: y for x, y in whole.items() if sum(x) % 2}


@pytest.mark.parametrize("cells", [5, 60, 2_000_000])
def test_top_pairs_equal_plain_loops(spark, monkeypatch, cells):
    """Changes that go on over slices and batches, chunks of one change at several times, ties, vectors without a length or an entry."""
    import math
    import random

    monkeypatch.setattr(vector_signal, "QUERY_BLOCK", 9)
    monkeypatch.setattr(vector_signal, "CELLS", cells)
    rng = random.Random(cells)
    vec = lambda k: [0.0] * 3 if k == 70 else [1.0, None, 1.0] if k % 41 == 7 else None if k % 37 == 5 else [float(rng.choice((-1, 1, 2))) for _ in range(3)]
    data = [(12 if 40 < k < 75 else k // 3, k % 11 // 10, 500 - k if k % 2 else k, k // 3 + k % 4, vec(k)) for k in range(150)]
    df = spark.createDataFrame(data, "pr_id long, repo_id int, chunk long, day int, embedding array<double>").withColumn("created_at", ts(spark, F.col("day"))).withColumn("in_corpus", F.lit(True)).repartition(5)
    q = df.filter("pr_id % 10 = 9 or pr_id = 12 or pr_id = 23").select(F.col("pr_id").alias("query_pr"), F.col("chunk").alias("query_chunk"), "repo_id", "created_at", "embedding")

    def cosine(v, w):
        size = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in w))
        return round(sum(x * y for x, y in zip(v, w)) / size, 6) if size else math.inf

    usable, pairs = [r for r in data if r[4] and None not in r[4]], {}
    for pr, repo, a, day, v in usable:
        if pr % 10 == 9 or pr in (12, 23):
            for other, r, b, d, w in usable:
                if r == repo and d < day and other != pr:
                    pairs.setdefault((pr, other), []).append((-cosine(v, w), a, b))
    named = lambda x: None if math.isinf(x) or math.isnan(x) else round(x, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        for k in (1, 3):
            want = {}
            for key, p in pairs.items():
                top = sorted(p)[:k]
                want[key] = (named(-top[0][0]), named(round(-sum(x[0] for x in top) / len(top) + 1e-9, 6)), *top[0][1:])
            rows = vector_signal.top_pairs(q, df, dim=3, k=k).collect()
            assert len(rows) == len(want) and {(r.query_pr, r.pr_id): (named(r.best), named(r.mean), r.query_chunk, r.best_chunk) for r in rows} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(x[0] is None for x in want.values()) and vector_signal.top_pairs(q.filter("false"), df, dim=3).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vector_signal.top_pairs(q, df, dim=2).collect()


def test_pairs_are_neither_joined_nor_shuffled_and_equal_sql(spark, tmp_path):
    import duckdb

    from lodestone import catalog

    data = [(k, [float((k * 7 + d * d) % 5 - 2) for d in range(64)] if k != 260 else [0.0] * 64) for k in range(1003)] + [(None, [1.0] * 64), (1010, None)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = catalog.pair_similarity_argmax(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    key = lambda r: tuple(map(str, r))
    got, want = sorted(map(key, out.collect())), sorted(map(key, db.execute(catalog.SQL["pair_similarity_argmax"]).fetchall()))
    assert len(want) == 50 + 100 + 150 + 200 and sum("nan" in r for r in want) > 0 and got == want


def test_lines_are_counted_by_any_line_end(spark):
    bodies = ["", "+", "+a\n+b\n-c", " x\r\n+y\r\n++z", "\n\n+\n\n-", "a+b\n c+\n", "+a\x0b+b\x0c-c\x1c+d\x1e+e\x85+f\u2028-g\u2029+h\t+i", "\r+\r\n+\n\r+", "+\n+\n+\n"]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for sign in "+-":
        split = F.size(F.filter(F.split("b", T.LINE_END), lambda x: F.startswith(x, F.lit(sign))))  # noqa: B023
        assert all(r[0] == r[1] for r in df.select(diffs._counted(F.col("b"), sign), split).collect())
    assert "split" not in df.select(diffs._counted(F.col("b"), "+"))._jdf.queryExecution().toString()


def test_bm25_top_terms(spark):
    docs = spark.createDataFrame([(k, "common pad " + ("alpha beta" if k < 2 else "gamma") * (k + 1)) for k in range(9)], "pr_id long, text string")
    q = spark.createDataFrame([(100, "alpha beta common gamma")], "query_pr long, text string")
    index = bm25.build(docs)
    parts = {}
    for r in bm25.parts(index, q).collect():
        parts.setdefault(r.pr_id, []).append((-round(r.part, 6), r.term))
    got = {r.pr_id: r.top_terms for r in bm25.top_terms(index, q, spark.createDataFrame([(100, 0), (100, 5)], "query_pr long, pr_id long")).collect()}
    assert got == {k: [t for _, t in sorted(parts[k])[:2]] for k in (0, 5)}


def test_embedding(spark):
    texts = ["def run(self): return 1", "DEF RUN(SELF): RETURN 1", "other words entirely", "", None, "x " * 300]
    e = {r.k: r for r in embedding.embed(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), "text").collect()}
    assert [e[k].token_count for k in range(6)] == [10, 10, 5, 2, 2, 302]
    assert all(len(r.embedding) == C.EMBEDDING_DIM and sum(x * x for x in r.embedding) == pytest.approx(1, abs=1e-5) for r in e.values())
    assert e[0].embedding == e[1].embedding and e[3].embedding == e[4].embedding and e[0].embedding != e[2].embedding
    assert embedding.embed(spark.createDataFrame([], "text string"), "text").collect() == []


def test_lean_raw_keeps_unknown_keys(spark):
    raw = json.dumps({"number": 1, "base": {"x": 1}, "head": {"sha": "abc", "y": 2}, "links": [], "_links": {}, "odd": {"deep": [1, None, "z"]}, "draft": False, "milestone": None})
    gone = json.dumps({"number": 2})
    a, b = (json.loads(r.j) for r in spark.createDataFrame([(raw,), (gone,)], "raw string").select(rows.lean_raw(F.col("raw")).alias("j")).collect())
    assert a == {"number": 1, "odd": {"deep": [1, None, "z"]}, "draft": False, "milestone": None, "head_sha": "abc"} and b == {"number": 2, "head_sha": None}


def test_a_missing_verdict_and_a_lost_change_are_errors(spark):
    items = rows.parse_items(spark.createDataFrame([(r,) for r in samples.ITEMS], "raw string"))
    verdicts = spark.createDataFrame(samples.VERDICTS, "number long, exclusion_reason string")
    d, gone = spark.createDataFrame(samples.DIFFS, "number long, diff string"), spark.createDataFrame([(11,)], "number long")
    with pytest.raises(Exception, match="no verdict for change 2"):
        rows.build(items, verdicts.filter("number <> 2"), d, gone).collect()
    c = d.filter("number <> 9").select("number", "number", F.lit(1).alias("repo_id"), F.current_timestamp().alias("created_at")).toDF("number", "pr_id", "repo_id", "created_at")
    with pytest.raises(Exception, match="unknown change 9"):
        rows.build_chunks(diffs.parse_hunks(d), c).collect()


def test_a_load_that_ends_between_the_renames_is_recovered(spark, tmp_path):
    t, s = spark.range(3), spark.range(5)
    path = f"{tmp_path}/out/t"
    store.load(t, path, f"{tmp_path}/stage")
    (tmp_path / "out/t").rename(tmp_path / "out/t.before")  # ended after the first rename
    store.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    (tmp_path / "out/t").rename(tmp_path / "out/t.before")
    store.load(s, path, f"{tmp_path}/stage")
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "out/t.before").exists()
    out = store.load_each({"good": (t, f"{tmp_path}/g"), "bad": (t.select(F.raise_error(F.lit("broken")).alias("x")), f"{tmp_path}/b")}, f"{tmp_path}/stages")
    assert out["good"] is None and "broken" in out["bad"] or out["bad"]


def test_repos(spark):
    repos = store.empty(spark, schemas.REPOS).unionByName(spark.createDataFrame([(4, 40, "o", "a", "o/a", "pending", 1, 0)], "id bigint, github_id bigint, owner string, name string, full_name string, status string, total_prs int, indexed_prs int"), allowMissingColumns=True)
    new = repos.withColumn("status", F.lit("ready")).unionByName(repos.withColumns({"github_id": F.lit(77).cast("long"), "full_name": F.lit("o/b")}))
    merged, ids = store.upsert_repo(repos, new)
    assert {r.full_name: r.id for r in ids.collect()} == {"o/a": 4, "o/b": 5}
    assert {r.full_name: (r.id, r.status) for r in merged.collect()} == {"o/a": (4, "ready"), "o/b": (5, "pending")}
    assert store.repo_by_name(merged, "o/b").first().github_id == 77 and store.repo_by_name(merged, "none").isEmpty()
    set_ = store.set_status(merged, "o/a", "done", 9).filter("full_name = 'o/a'").first()
    assert (set_.status, set_.indexed_prs) == ("done", 9) and set_.indexed_at is not None
    assert store.by_ids(merged, merged.select("id").limit(1), "id").count() == 1


def test_seeds(spark, tmp_path):
    r = spark.createDataFrame([(1, ["x"], {"vector": 0.5})], "query_pr long, results array<string>, weights map<string,double>")
    store.seeds(r, f"{tmp_path}/seed", model="hashed")
    back = spark.read.json(f"{tmp_path}/seed").first()
    assert (back.query_pr, back.model, back.results) == (1, "hashed", ["x"]) and back.generated_at


def test_more_checks_and_tallies(spark):
    pages = spark.createDataFrame([(p,) for p, n in ((1, 100), (2, 100), (3, 7)) for _ in range(n)], "page int")
    assert checks.tail_short(pages).first().ok and not checks.tail_short(pages.filter("page > 1").unionByName(pages.filter("page = 3").selectExpr("4 as page"))).first().ok
    assert checks.scores_in_range(spark.createDataFrame([(0.5,), (1.1,), (0.0,)], "s double"), "s").first().outside == 1
    t = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), ("a",)], "x string")
    assert [tuple(r) for r in corpus.most_common(t, "x", 2).collect()] == [("a", 2), ("b", 2)]
    assert corpus.branch_tally(spark.createDataFrame([("Fix it.", " fix IT"), ("Fix it", "Fix that")], "title_a string, title_b string")).first() == (1, 1)


def test_results_do_not_depend_on_the_order_of_rows(spark):
    query, chunks = chunk_frames(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    one = key(vector_signal.signal(query, chunks, dim=2))
    assert key(vector_signal.signal(query.orderBy(F.desc("query_pr")), chunks.orderBy(F.desc("pr_id")).repartition(3), dim=2)) == one
    df = group(spark, [(k, "a", "T", float(k * 3 % 17), False) for k in range(12)])
    assert key(corpus.verdicts(df)) == key(corpus.verdicts(df.orderBy(F.rand(3)).repartition(3)))


def test_short_items_are_judged_too(spark, tmp_path):
    from lodestone import catalog

    spark.createDataFrame([(1, "rare words here"), (2, "one"), (3, "a b c d e f"), (4, "b c d e")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "some rare words here it is"), (2, "someone is"), (3, "xa b c d e fx"), (4, "b c d ease"), (5, "nothing")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r.query_pr, r.pr_id) for r in catalog.judgments(spark, str(tmp_path)).collect()}
    assert got == {(-2, 1), (-3, 2), (-4, 3), (-5, 3), (-5, 4)}


def test_entry_without_the_optional_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and set(e.oracle_sql()) <= set(q) and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_pages_end_at_the_first_short_one(spark):
    page = lambda p, n: [(p, k, f"{p}:{k}") for k in range(n)]
    frame = lambda *sizes: spark.createDataFrame([r for p, n in sizes for r in page(p, n)], "page int, pos int, raw string")
    seen = lambda df: sorted({r.page for r in df.collect()})
    assert seen(snapshot.until_short(frame((1, 100), (2, 40), (3, 100)))) == [1, 2]
    assert seen(snapshot.until_short(frame((1, 100), (2, 100), (4, 100)))) == [1, 2]
    assert seen(snapshot.until_short(frame((2, 100)))) == []
    both = snapshot.cache_first(frame((1, 100), (2, 40)), frame((1, 3), (2, 60), (3, 5)))
    assert {r.page: r.n for r in both.groupBy("page").count().withColumnRenamed("count", "n").collect()} == {1: 100, 2: 60, 3: 5}


def test_only_refusals_are_tried_again():
    class Refused(OSError):
        def __init__(self, code):
            self.code = code

    def call():
        made.append(1)
        raise Refused(code)

    for code, calls in ((404, 1), (429, 3)):
        made = []
        with pytest.raises(Refused):
            snapshot.with_retry(call, attempts=3, sleep=lambda s: None)
        assert len(made) == calls


def test_chunks_are_joined_before_they_are_vectors_and_diffs_are_made_once(spark):
    own = catalog.QUERIES["chunk_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert own.count("FileScan") == 1 and "Join" not in own and "_measures(_vectors(" in own
    d = spark.createDataFrame(samples.DIFFS, "number long, diff string")
    c = d.selectExpr("number", "number + 100 AS pr_id", "1 AS repo_id", "timestamp_seconds(number) AS created_at")
    joined, kept = rows.build_chunks(diffs.parse_hunks(d), c), rows.build_chunks(diffs.parse_hunks(d.join(c, "number"), keep=rows.CHANGE_OF_CHUNK))
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("EvalPython") < plan.index("Join")  # the upper one stands first
    assert joined.columns == kept.columns and sorted(map(tuple, joined.collect())) == sorted(map(tuple, kept.collect()))


def test_vectors_lines_and_case_beyond_ascii(spark):
    texts = ["\u00c5 b", "\u00e5 B", "\u0130x", "\U00010d50 y", "\U00010d70 Y", "K \u212a", "\U0001f600 a_1", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    e = embedding.embed(t, "text")
    lowered = {r.k: r.w for r in t.select("k", F.transform(embedding.tokens(F.col("text")), F.lower).alias("w")).collect()}
    for r in e.select("*", embedding.measures(F.col("embedding")).alias("m")).collect():
        m = [0.0] * C.EMBEDDING_DIM
        for w in lowered[r.k] or [""]:
            h = hashlib.md5(w.encode()).hexdigest()
            m[int(h[:8], 16) % C.EMBEDDING_DIM] += 1.0 if int(h[8], 16) % 2 == 0 else -1.0
        n = sum(x * x for x in m) ** 0.5
        assert r.embedding == pytest.approx([x / n for x in m], abs=1e-6) and r.token_count == len(lowered[r.k]) + 2
        assert tuple(r.m) == pytest.approx((1, sum(m) / n, max(m) / n), abs=1e-6)
    bodies = ["+a\n+b\r\n+c", "++\n+", "\U0001f600+\n\u2028+\x85+ +", "", "a+b\x1c+-\x0b-", "+", "\r+\r\n-"]
    got = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", diffs._counted(F.col("b"), "+").alias("p"), diffs._counted(F.col("b"), "-").alias("m")).collect()
    assert [(r.p, r.m) for r in got] == [tuple(sum(x.startswith(s) for x in r.b.splitlines()) for s in "+-") for r in got]
