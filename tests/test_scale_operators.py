"""Operators that spread what would meet in one task: anchored groups, containment, tables in parts, loads with errors aside."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.operators import corpus, sets
from lodestone.sources import parts, store

CHANGES = "number long, author string, title string, created_at timestamp, key string, anchor long"


def plain_groups(rows, days=7):
    out, groups = {}, {}
    for number, author, title, at in rows:
        if at is None:
            out[number] = number
            continue
        groups.setdefault((author, (title or "").strip().lower()), []).append((at, number))
    for members in groups.values():
        begin = None
        for at, number in sorted(members):
            if begin is None or at > begin[0] + timedelta(days=days):
                begin = (at, number)
            out[number] = begin[1]
    return out


def made_changes(seed, n):
    rng = random.Random(seed)
    t0 = datetime(1969, 12, 1, tzinfo=timezone.utc)
    rows = []
    for k in range(n):
        at = t0 + timedelta(seconds=rng.choice([0, 60, 3600]) * rng.randrange(1000)) + timedelta(days=rng.choice([0, 7, 7, 14, rng.randrange(90)]))
        rows.append((1000 - k if k % 3 else 2000 + k, rng.choice(["a", "b", None]), rng.choice(["T", " t ", None, "", "other"]), at if rng.random() > 0.03 else None))
    return rows


@pytest.mark.parametrize("fold_rows", [0, 20, 1000])
def test_anchors_by_doubling(spark, fold_rows):
    rows = made_changes(fold_rows, 250)
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], CHANGES).drop("key", "anchor")
    got = {r.number: (r.anchor, r.group_size) for r in corpus.group_duplicates(df, fold_rows=fold_rows).collect()}
    want = plain_groups(rows)
    assert {k: a for k, (a, _) in got.items()} == want
    assert all(size == sum(a == b for b in want.values()) for a, size in got.values())


def test_a_limit_is_inclusive_to_the_microsecond(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    at = [t0, t0 + timedelta(days=7), t0 + timedelta(days=7, microseconds=1), t0 + timedelta(days=14, microseconds=1), t0 + timedelta(days=14, microseconds=2)]
    df = spark.createDataFrame([(k, "a", "x", t, "", 0) for k, t in enumerate(at)], CHANGES).drop("key", "anchor")
    for fold_rows in (0, 100):
        assert {r.number: r.anchor for r in corpus.group_duplicates(df, fold_rows=fold_rows).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_anchors_are_not_repeated_for_each_piece_of_time(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(k, f"author {k % 50}", t0 + timedelta(days=k % 90)) for k in range(500)], "number long, key string, t timestamp")
    out = corpus.anchors_by_doubling(df, 7)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = plain_groups([(r.number, r.key, "", r.t) for r in df.collect()])
    assert {r.number: r.anchor for r in out.collect()} == want


def plain_relations(a, b):
    canon = lambda g: {n: frozenset(x for x in m if x is not None) for n, m in g.items() if any(x is not None for x in m)}
    a, b, out = canon(a), canon(b), {}
    for n, x in a.items():
        for m, y in b.items():
            relation = "equal" if x == y else "inside" if x < y else "contains" if x > y else None
            if relation:
                out.setdefault((n, relation), []).append(m)
    return sorted((n, r, len(v), min(v)) for (n, r), v in out.items())


def test_set_containment(spark):
    rng = random.Random(3)
    groups = lambda base: {base + k: [rng.choice([*range(12), None]) for _ in range(rng.randrange(0, 6))] + [0] * (k % 2) for k in range(60)}
    a, b = groups(0), groups(1000)
    df = lambda g: spark.createDataFrame(list(g.items()), "name long, members array<int>")
    assert sorted(map(tuple, sets.relations(df(a), df(b)).collect())) == plain_relations(a, b)
    rows = spark.createDataFrame([(n, x) for n, m in a.items() for x in m], "name long, members int")
    assert sorted(map(tuple, sets.relations(rows, df(b)).collect())) == plain_relations(a, b)
    assert sets.relations(df(a).filter("false"), df(b)).count() == 0 and sets.relations(df(a), df(b).filter("false")).count() == 0


def files_of(table):
    m = table.manifest()
    return {int(k): f for k, f in m["folders"].items()}


def test_upsert_rewrites_only_its_parts(spark, tmp_path):
    t = parts.KeyedTable(spark, f"file://{tmp_path}/t", ["repo_id", "number"], ["author"], parts=8)
    row = lambda k, author, body: (1, k, author, body)
    schema = "repo_id int, number long, author string, body string"
    assert t.manifest() is None
    with pytest.raises(FileNotFoundError):
        t.read()
    assert t.upsert(spark.createDataFrame([row(k, "old", "x") for k in range(200)], schema)) == 1
    before, reader = files_of(t), t.read()
    source = spark.createDataFrame([row(5, "new", None), row(1000, "new", "y")], schema)
    assert t.upsert(source) == 2
    after = files_of(t)
    touched = {r.p for r in source.select(t._part().alias("p")).collect()}
    assert {k for k in after if after[k] != before.get(k)} == touched and len(touched) < 8
    rows = {r.number: (r.author, r.body) for r in t.read().collect()}
    assert len(rows) == 201 and rows[5] == ("old", None) and rows[1000] == ("new", "y") and rows[6] == ("old", "x")
    assert reader.filter("body is null").count() == 0 and reader.count() == 200  # a reader of the version before
    assert t.insert_ignore(spark.createDataFrame([row(5, "z", "z"), row(2000, "z", "z"), row(2000, "z", "z")], schema)) == 3
    rows = {r.number: (r.author, r.body) for r in t.read().collect()}
    assert len(rows) == 202 and rows[5] == ("old", None) and rows[2000] == ("z", "z")
    assert t.insert_ignore(source) == 3 and t.upsert(source.filter("false")) == 3
    assert t.vacuum() > 0 and t.read().count() == 202


def test_two_writers_of_one_version(spark, tmp_path):
    schema = "k int, v string"
    make = lambda: parts.KeyedTable(spark, f"file://{tmp_path}/t", ["k"], parts=4)
    one, two = make(), make()
    one.overwrite(spark.createDataFrame([(1, "a")], schema))
    stale = two.manifest()
    one.upsert(spark.createDataFrame([(2, "b")], schema))
    with pytest.raises(parts.Conflict):
        two._commit(stale, spark.createDataFrame([(3, "c")], schema), [0, 1, 2, 3])
    assert sorted(r.k for r in two.read().collect()) == [1, 2]


ITEM = '{{"number": {0}, "id": {0}, "title": "t", "user": {{"login": "u", "type": "User"}}, "state": "closed", "created_at": "{1}", "labels": [], "head": {{"sha": "s"}}}}'
DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n"


def test_one_bad_record_costs_itself_only(spark, tmp_path):
    from lodestone.operators import rows

    n = 1000
    raw = [(ITEM.format(k, "2024-01-01T00:00:00Z"),) for k in range(n)] + [("{not json",), (ITEM.format(n, "soon"),), (ITEM.format(n + 1, "2024-01-01T00:00:00Z"),)]
    items = rows.parse_items(spark.createDataFrame(raw, "raw string"))
    verdicts = spark.range(n + 1).selectExpr("id as number", "cast(null as string) as exclusion_reason")
    diffs = spark.createDataFrame([(k, "<html>rate limited</html>" if k == 7 else DIFF) for k in range(n + 1) if k != 9], "number long, diff string")
    none = spark.createDataFrame([], "number long")
    out = rows.judged(items, verdicts, diffs, none)
    got = store.load_aside(out, f"file://{tmp_path}/rows", f"file://{tmp_path}/errors", f"file://{tmp_path}/staging")
    assert got == {"rows": 998, "errors": 5}
    good, bad = spark.read.parquet(f"{tmp_path}/rows"), spark.read.parquet(f"{tmp_path}/errors")
    assert good.count() == 998 and good.filter("error is not null or number in (7, 9)").count() == 0 and good.filter("in_corpus and additions = 1 and deletions = 1").count() == 998
    assert sorted(r.error for r in bad.collect()) == ["no diff for change 9", "no file in the diff of change 7", "no item: {not json", f"no time in created_at of change {n}", f"no verdict for change {n + 1}"]
    # the bad ones are mended and all are loaded again
    mended = rows.judged(items.filter("number < 1000"), verdicts, spark.range(n).select(F.col("id").alias("number"), F.lit(DIFF).alias("diff")), none)
    assert store.load_aside(mended, f"file://{tmp_path}/rows", f"file://{tmp_path}/errors", f"file://{tmp_path}/staging") == {"rows": n, "errors": 0}
    assert spark.read.parquet(f"{tmp_path}/rows").count() == n and spark.read.parquet(f"{tmp_path}/errors").count() == 0


def test_order_free_fingerprint(spark):
    from lodestone.operators import checks

    rows = [(1, "a", None), (2, None, "b"), (2, None, "b"), (3, "", None)]
    df = lambda r: spark.createDataFrame(r, "k int, x string, y string")
    same = lambda a, b: checks.same_rows(a, b).first().same
    a = df(rows)
    assert same(a, df(rows[::-1]).repartition(3)) and same(a, a.select("y", "k", "x")) and same(df([]), df([]))
    for other in (rows[:3], [*rows, rows[0]], [(1, None, "a"), *rows[1:]], [*rows[:3], (3, None, None)], [rows[0], rows[1], rows[3], rows[3]]):
        assert not same(a, df(other))
