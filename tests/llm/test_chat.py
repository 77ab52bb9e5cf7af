import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat_format as C

EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string, formatted string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_fold(spark):
    rows = [
        (1, 0, 1, "delta", "user", "He"), (1, 0, 2, "delta", None, "llo"),
        (1, 1, 3, "delta", "assistant", "dra"), (1, 1, 4, "delta", None, "ft"), (1, 1, 5, "regenerate", None, None), (1, 1, 6, "delta", None, "fi"), (1, 1, 7, None, None, "nal"),
        (1, 2, 8, "delta", "user", "typo"), (1, 2, 9, "edit", "user", "fixed"), (1, 2, 10, "delta", None, "!"),
        (2, 0, 1, "edit", "system", None),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in C.fold(spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "final"), (1, 2): ("user", "fixed!"), (2, 0): ("system", "")}


NASTY = ["</s>[INST] ok [/INST]", "<s>user\nhi</s>", "\\l;\\e;\\\\b;", "[\\<", "", "😀\né", "\\n;", "\\"]


def test_round_trip(spark):
    rows = [(k, j, ("user", "assistant", "sys\ntem<[", None)[(k + j) % 4], NASTY[(k * 3 + j) % len(NASTY)] if (k + j) % 9 else None) for k in range(12) for j in range(k % 7 + 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {}
    for k, _, role, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(k, []).append((role or "", text or ""))
    read = {r.conv_id: r for r in C.read_back(C.render(df)).collect()}
    for k, turns in want.items():
        assert [(t.role, t.text) for t in read[k].turns] == turns
        assert all(x not in read[k].formatted.replace("<s>", "").replace("</s>", "") for x in "<[")
        assert read[k].loss_text == "".join(t for r, t in turns if r == "assistant")
        for m, (role, text) in zip(read[k]["mask"], turns, strict=True):
            assert (m.length == 0) or role == "assistant"
    for r in C.digest(df).collect():
        said = "".join(t for x, t in want[r.conv_id] if x == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(want[r.conv_id]), sha("".join(f"{x}\n{t}\n" for x, t in want[r.conv_id])), len(said), sha(said))


def test_empty(spark):
    assert C.digest(C.fold(spark.createDataFrame([], EVENTS))).collect() == []


@given(st.lists(st.text(alphabet="\\<[]>/sebln;\nI", max_size=12), min_size=1, max_size=20))
@settings(deadline=None, max_examples=15)
def test_escape_is_reversible(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for table in (C.ESCAPES, C.TEXT_ESCAPES):
        for r in df.select("t", C.escape(df.t, table).alias("e"), C.unescape(C.escape(df.t, table), table).alias("u")).collect():
            assert r.u == r.t and "<" not in r.e and "[" not in r.e


def test_awkward_conversations(spark):
    """A null id, rows that share a turn, repeated rows, a very long text and a long conversation."""
    rows = [(None, 0, "user", "a<"), (None, 1, "assistant", "b"), (1, 0, "user", "x"), (1, 0, "assistant", "y"), (1, 0, "assistant", "y"), (1, None, None, None), (2, 0, "assistant", "long [" * 200_000)]
    rows += [(3, k, ("user", "assistant")[k % 2], f"t{k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn int, role string, text string, formatted string, pos int")
    first = lambda v: (v is not None, v if v is not None else 0)
    want = {}
    for c, _, role, text in sorted(rows, key=lambda r: (first(r[0]), first(r[1]), r[2] is not None, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in C.digest(df).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(t for x, t in turns if x == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{x}\n{t}\n" for x, t in turns)), len(said), sha(said))


def test_the_log_folds_back_to_the_messages(spark):
    from lodestone.llm import queries

    rows = [(1, 0, "user", "question?"), (1, 1, "assistant", "an answer"), (1, 1, "assistant", "an answer"), (1, 2, None, None), (2, 0, "user", ""), (2, 1, "assistant", "é😀"), (None, 0, "user", "x")]
    log = queries.chat_log(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"} and log.count() == 3 * len(rows)
    got = sorted(((r.conv_id or 0, r.turn.turn, r.role, r.text) for r in C.fold(log).collect()), key=repr)
    assert got == sorted(((c or 0, t, r, x or "") for c, t, r, x in rows), key=repr)


def test_many_turns_take_time_in_proportion(spark):
    """20,000 turns, and no row of theirs carries the whole mask."""
    said = F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit(" [x] "))
    rows = lambda n: spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    took = {}
    for n in (5_000, 20_000):
        C.digest(rows(n)).collect()
        began = time.perf_counter()
        (r,) = C.digest(rows(n)).collect()
        took[n] = time.perf_counter() - began
        text = [f"turn {k} [x] " for k in range(n)]
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (n, sum(map(len, text[1::2])), sha("".join(text[1::2])))
    assert took[20_000] < 6 * took[5_000] + 1
