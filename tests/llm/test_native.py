import random
import re

import pytest

from docsift.llm import chat, quality
from docsift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, same):
    same(QUERIES[name], ORACLES[name])


def test_ledger_of_odd_rows(odd, none, duck, spark):
    import duckdb

    got = quality.apply_policy(quality.ledger(odd)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")
    c = duckdb.connect()
    documents = odd.toPandas()  # noqa: F841
    c.register("documents", documents)
    want = c.execute(quality.ORACLE).fetchall()
    assert sorted(str((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:])) for r in want) == sorted(str(tuple(r)) for r in got.collect())
    assert quality.ledger(none).count() == 0


def test_repeats(spark):
    cases = [("a b c a b c", 6), ("a a a a", 4), ("a b c d e", 0), ("a b c x a b c d a b c d", 11), ("x y", 0)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.n_repeat_words for r in quality.measure(rows).orderBy("doc_id").collect()] == [n for _, n in cases]


def test_ablations(spark):
    bits = [0, 1, 1, 4, 5, 12]
    got = {r.rule: (r.n_failed, r.n_only_this) for r in quality.ablations(spark.createDataFrame([(b,) for b in bits], "fail_bits long"), "2025.1").collect()}
    assert got == {"too_few_words": (3, 2), "symbols": (3, 1), "repeated_lines": (1, 0), "repeated_windows": (0, 0)}


def test_no_python_in_native_plans(spark, odd):
    for name in ("op3_quality_rules", "op4_chat"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


TALK = [
    (1, 0, "u", "Hello there. How are you today?\nI am fine."), (1, 1, "a", "> Hello there. How are you today?\nGood thanks. The weather is nice."), (1, 2, "u", "Other topic here."),
    (1, 3, "u", "On Monday A wrote:\n>> Hello there. How are you\n> Good thanks. The weather\n> is nice.\n\nIndeed it is!"), (1, 4, "a", "> unknown thing\nwhat"),
    (1, 5, "a", ">Indeed it is!\nyes"), (1, 5, "b", ">Indeed it is!\nyes"), (2, 0, "a", "> Other topic here.\nnot of this conversation"), (None, 5, "a", "> Hello there.\nx"), (2, None, None, None), (3, 0, "a", ""),
]


def test_quotes(spark):
    frame = spark.createDataFrame([(*t, "kept", "gone") for t in TALK], "conv_id long, turn long, role string, text string, extra string, thread string")
    out = chat.link(frame)
    rows = {(r.conv_id, r.turn, r.role): r for r in out.collect()}
    assert len(rows) == len(TALK) and all(r.extra == "kept" for r in rows.values())
    told = {k: (r.reply_to, r.thread, r.depth, r.n_quotes) for k, r in rows.items()}
    assert told[1, 1, "a"] == (0, 0, 1, 1) and told[1, 3, "u"] == (1, 0, 2, 2) and told[1, 5, "a"] == told[1, 5, "b"] == (3, 0, 3, 1)
    assert told[1, 4, "a"] == (None, 4, 0, 1) and told[1, 2, "u"] == (None, 2, 0, 0) and told[2, 0, "a"] == (None, 0, 0, 1) and told[None, 5, "a"] == (None, 5, 0, 1)
    assert rows[1, 3, "u"].text == "\nIndeed it is!" and rows[2, None, None].text == "" and all(">" not in r.text for r in rows.values())
    order = [r.turn for r in out.where("conv_id = 1").collect()]
    assert order == [0, 1, 3, 5, 5, 2, 4]
    assert chat.link(frame.where("false")).count() == 0


def test_origins_over_slices(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 4)
    talk = [(1, t, "Same words." if t % 5 == 0 else f"Text number {t}.") for t in range(40)]
    talk += [(1, t, "> Same words.\nreply") for t in (2, 5, 19, 44)]
    frame = spark.createDataFrame(talk, "conv_id long, turn long, text string")
    got = {r.turn: r.reply_to for r in chat.link(frame).where("n_linked > 0").collect()}
    assert got == {2: 0, 5: 0, 19: 15, 44: 35}


def test_long_reply_chain(spark):
    frame = spark.createDataFrame([(1, 0, "Unique 0.")] + [(1, t, f"> Unique {t - 1}.\nUnique {t}.") for t in range(1, 40)], "conv_id long, turn long, text string")
    assert [(r.turn, r.depth, r.thread) for r in chat.link(frame).collect()] == [(t, t, 0) for t in range(40)]


def test_query_4(spark):
    got = QUERIES["op4_chat"](spark, DATA)
    talk = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert got.count() == talk.count() and got.where("n_quotes = 0").select("conv_id", "turn", "role", "text").exceptAll(talk).count() == 0


def test_wrapped_quotes(spark):
    """Sentences that a mail client wraps anew are found, and so is a paragraph of a longer message."""
    said = "First thing to say, which is long. The second sentence is longer than\nthe first one was. A third one ends it.\n\nAnother paragraph here, with no stop\nat all"
    wrapped = "> First thing to say,\n> which is long. The second sentence is longer\n> than the first one was.\nYes."
    paragraph = "> Another paragraph here, with\n> no stop at all\nI see."
    rows = {r.turn: r for r in chat.link(spark.createDataFrame([(1, 0, said), (1, 1, wrapped), (1, 2, paragraph)], "conv_id long, turn long, text string")).collect()}
    assert (rows[1].reply_to, rows[1].n_linked, rows[1].text) == (0, 2, "Yes.") and (rows[2].reply_to, rows[2].text) == (0, "I see.")


def plain_links(talk):
    """(turn, text, reply_to, n_linked) of one conversation, message by message."""
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()

    def units(text):
        paragraphs = re.split(r"\n\s*\n", text)
        out = [text, *paragraphs, *(x for p in paragraphs for x in re.split(r"[.!?…]+(?:\s+|$)", p)), *re.split(r"[.!?…]+(?:\s+|$)|\n", text)]
        return {norm(x) for x in out} - {""}

    level = lambda line: re.match(r"[ \t]*((?:>[ \t]?)*)", line)[1].count(">")
    said, out = [], []
    for turn, text in talk:
        lines, own, passages = text.split("\n"), [], []
        for k, x in enumerate(lines):
            after = level(lines[k + 1]) if k + 1 < len(lines) else 0
            if level(x):
                body = re.sub(r"^[ \t]*(?:>[ \t]?)+", "", x)
                if k and level(lines[k - 1]) == level(x):
                    passages[-1][1].append(body)
                else:
                    passages.append((level(x), [body]))
            elif not (after and re.fullmatch(r"On .+ wrote:", x)):
                own.append(x)
        votes, n = {}, 0
        for lv in {p[0] for p in passages}:
            for u in set().union(*(units("\n".join(b)) for v, b in passages if v == lv)):
                origins = [t for t, us in said if u in us]
                if origins:
                    n += 1
                    votes.setdefault(lv, []).append(max(origins))
        outer = votes[min(votes)] if votes else []
        reply = max(set(outer), key=lambda t: (outer.count(t), t)) if outer else None
        out.append((turn, "\n".join(own), reply, n))
        said.append((turn, units("\n".join(own))))
    return out


def test_links_against_plain_version(spark):
    rng = random.Random(7)
    words = "tree house road small green they went home again".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(2, 4))) + rng.choice(".!?")
    rows, want = [], []
    for conv in range(12):
        talk = []
        for turn in range(15):
            parts = []
            if talk and rng.random() < 0.7:
                quoted = rng.choice(talk)[1].split("\n")
                a = rng.randrange(len(quoted))
                quoted = quoted[a : a + rng.randint(1, 3)]
                parts = [*["On Monday somebody wrote:"] * (rng.random() < 0.5), *("> " + x if not x.startswith(">") else ">" + x for x in quoted)]
            parts += ["", *(sentence() for _ in range(rng.randint(1, 3)))]
            talk.append((turn, "\n".join(parts)))
        rows += [(conv, *t) for t in talk]
        want += [(conv, *t) for t in plain_links(talk)]
    got = chat.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()
    assert sorted(((r.conv_id, r.turn, r.text, r.reply_to, r.n_linked) for r in got), key=lambda x: x[:2]) == want


def test_announcements(spark):
    """However long, and over two lines; a line like it that no quote follows stays."""
    long_ = "On " + "a very long date " * 40 + "A wrote:"
    texts = [f"{long_}\n> x y\nyes", "On Monday, the first of May,\nsomebody <a@b> wrote:\n> x y\nyes", "    > x y\nyes", "On Monday A wrote:\nyes", "x" * 200_000 + "\n> x y"]
    got = {r.turn: r.text for r in chat.link(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string")).collect()}
    assert got == {0: "yes", 1: "yes", 2: "yes", 3: texts[3], 4: "x" * 200_000}


def test_ablations_of_nothing(spark):
    assert {(r.n_failed, r.n_only_this) for r in quality.ablations(spark.createDataFrame([], "fail_bits long"), "base").collect()} <= {(0, 0)}
    assert {r.rule: r.n_failed for r in quality.ablations(spark.createDataFrame([(None,), (1,)], "fail_bits long"), "base").collect()} == {"too_few_words": 1, "repeated_windows": 0}
