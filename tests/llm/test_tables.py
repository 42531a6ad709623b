import json
import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgrid.llm import chat, langid, neardup, quality, topk
from quillgrid.llm.components import components
from quillgrid.llm.queries import ORACLE, QUERIES


def norm(v):
    return "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rows = QUERIES[name](spark, sf)
    got = c.execute(ORACLE[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(rows.columns)
    at = [names.index(x) for x in rows.columns]
    assert sorted(tuple(norm(v) for v in r) for r in rows.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())


def words(text):
    return (text or "").encode().lower().split()


def sets_of(docs):
    out = {}
    for i, text in docs.items():
        w = words(text)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def linked(docs):
    """Least id reachable, by brute force."""
    sets = sets_of(docs)
    parent = {i: i for i in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_on_table(spark, sf):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, sizes = linked(docs)
    got = QUERIES["op10_minhash_neardup"](spark, sf).collect()
    assert {r.doc_id: r.component_id for r in got} == want and {r.doc_id: r.n_shingles for r in got} == sizes
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def edited_group(seed, base, copies, most):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(copies):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, most + 1)):
            w[at] = f"x{rng.integers(1_000_000)}"
        out.append(" ".join(w))
    return out


def test_large_near_copy_group_and_common_passage(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 16)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(100_000)}"
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    texts = edited_group(1, base, 150, 9) + [passage + " " + " ".join(word() for _ in range(60)) for _ in range(80)] + ["same text of six words here"] * 20
    docs = {i: t for i, t in enumerate(texts)}
    want, _ = linked(docs)
    got = neardup.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) > 85


def test_near_duplicates_of_odd_rows(spark):
    rows = [(5, "a b c d e f", 1), (3, "A  b c\td e\nf", 1), (7, None, 1), (8, "", 1), (9, " \n", 1), (None, "a b c d e f", 1), (10, "one two", 1), (11, "one two", 1), (12, "two one", 1), (5, "a b c d e f", 1), (13, "w " * 50_000, 1)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long")).collect()
    told = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}
    assert len(got) == 11
    assert told[5] == (2, 3, False) and told[3] == (2, 3, True) and told[7] == (0, 7, True) and told[9] == (0, 9, True)
    assert told[None][1:] == (None, True) and told[10] == (1, 10, True) and told[11] == (1, 10, False) and told[12] == (1, 12, True) and told[13] == (1, 13, True)
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "k"), (2, "a b c d e f g", "k"), (1, "a b c d e f g", "k"), (4, None, "k"), (4, None, "k"), (None, "a b c d e f g", None), (6, "other text with some more words", "k"), (2, "yet another text with many words", "k")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    assert sorted((str(r.doc_id), str(r.text)[:5]) for r in got) == [("1", "a b c"), ("2", "yet a"), ("4", "None"), ("6", "other"), ("None", "a b c")]
    assert got[0].component_id is not None or got[0].doc_id is None


def test_every_pair_within_the_guaranteed_distance_meets():
    rng = np.random.default_rng(2)
    most = neardup.REACH
    for _ in range(200):
        a = rng.integers(0, 1 << neardup.BITS, neardup.SLOTS)
        b = a.copy()
        off = rng.choice(neardup.SLOTS, most, replace=False)
        b[off] = (b[off] + rng.integers(1, 1 << neardup.BITS, most)) % (1 << neardup.BITS)
        assert ((a != b).reshape(neardup.CHUNKS, neardup.CHUNK).sum(axis=1) <= 1).any()


def test_links_at_just_the_similarity(spark):
    """Pairs whose sets agree in exactly 75 of 100 parts are all found, and those just below are none."""
    texts = [" ".join(f"p{k}x{i}" for i in range(n)) for k in range(600) for n in (79, 104)]  # 75 of 100 shingles
    texts += [" ".join(f"q{k}x{i}" for i in range(n)) for k in range(300) for n in (78, 104)]  # 74 of 100
    rng = np.random.default_rng(12)
    docs = spark.createDataFrame([(i, texts[i]) for i in rng.permutation(len(texts)).tolist()], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert all(got[2 * k + 1] == 2 * k for k in range(600)) and all(got[i] == i for i in range(1200, 1800))


def test_near_duplicates_without_the_filter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    monkeypatch.setattr(neardup, "FILTER_NODES", 0)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want
    with pytest.raises(TypeError):
        neardup.near_duplicates(docs.withColumn("doc_id", docs.doc_id.cast("string")))


@pytest.mark.parametrize("edges,want", [([], {}), ([(5, 3), (3, 9), (9, 9)], {5: 3, 3: 3, 9: 3}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)}), ([(100, i) for i in range(20)] + [(7, 200)], {**{i: 0 for i in range(20)}, 100: 0, 200: 0})])
def test_components(spark, edges, want):
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_quality_of_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good + f" extra{i}", "en", "s", 1) for i in range(30)] + [(100, None, None, None, 1), (101, "", "en", None, 1), (102, "a a a " * 40, "en", "s", 1), (103, " ".join(f"w{i}%%%" for i in range(90)), "en", "s", 1), (104, good, None, "s", 1), (104, good, None, "s", 1), (None, good + "\n" + good, "en", "s", 1)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept long")).collect()
    told = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(told[i].kept for i in range(30))
    assert told[100].base_failed and told[101].base_failed and told[102].base_failed and not told[102].kept
    assert not told[103].base_failed and not told[103].kept and told[103].n_symbols == 270
    assert told[None].base_failed and told[None].n_dup_lines == 1 and told[None].n_repeat_words == 160
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []


def test_fences_follow_their_group(spark):
    """Groups of other habits get other fences, whatever their size; the same text is in or out by its group."""
    rng = np.random.default_rng(3)
    word = lambda n: "".join("abcdefghij"[k] for k in rng.integers(0, 10, n))

    def text(length, symbols, n=100):
        own = [word(int(length + rng.integers(-1, 2))) for _ in range(n)]
        return " ".join(w + "#" * int(k < symbols) for k, w in enumerate(own))

    rows = [(f"{lang}{source}", text(length, int(rng.integers(0, symbols + 1))), lang, source) for lang, source, length, symbols, n in [("x", "plain", 4, 0, 200), ("x", "code", 8, 40, 200), ("x", "few", 8, 40, 12), ("y", "plain", 12, 0, 150)] for _ in range(n)]
    docs = spark.createDataFrame([(i, t, lang, source) for i, (_, t, lang, source) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    measures = quality.with_measures(quality.features(docs, ["doc_id", "lang", "source"]))
    fences = {(r.lang, r.source): r for r in quality.thresholds(quality.sketches(measures, "lang", "source")).collect()}
    assert fences["x", "plain"].high_symbols < 200 and fences["x", "code"].high_symbols > 400
    assert fences["x", "plain"].high_word_length < fences["x", "code"].high_word_length < fences["y", "plain"].high_word_length
    assert fences["x", "plain"].high_symbols < fences["x", "few"].high_symbols < fences["x", "code"].high_symbols  # between its own and its language's
    out = quality.judged(docs.union(spark.createDataFrame([(9001, text(4, 30), "x", "plain"), (9002, text(8, 30), "x", "code"), (9003, text(4, 0), "y", "plain")], docs.schema)))
    told = {r.doc_id: r.outside for r in out.where("doc_id > 9000").collect()}
    assert "symbols" in told[9001] and told[9002] == "" and told[9003] == "word_length"
    assert out.where("not kept and doc_id < 9000 and source != 'few'").count() <= 5


def test_every_measure_rejects_on_its_own(spark):
    rng = np.random.default_rng(8)
    word = lambda: "".join("abcdefghij"[k] for k in rng.integers(0, 10, 6))
    lines = lambda n: [" ".join(word() for _ in range(10)) for _ in range(n)]
    rows = [(i, "\n".join(lines(10))) for i in range(300)]
    one, twice = lines(12), [word() for _ in range(30)]
    rows += [(1001, " ".join(w + "xxxxxxxxxx" for w in " ".join(lines(10)).split())), (1002, "\n".join(f"{x} ###" for x in lines(10)))]
    rows += [(1003, "\n".join(one + ["ab"] * 6)), (1004, " ".join(" ".join(lines(6)).split() + twice + twice))]
    docs = spark.createDataFrame([(i, t, "l", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.outside, r.kept, r.base_failed) for r in quality.judged(docs).collect()}
    assert got[1001][0] == "word_length" and "symbols" in got[1002][0] and "repeated_lines" in got[1003][0] and got[1004][0] == "repeated_words"
    assert not any(got[i][2] or got[i][1] for i in range(1001, 1005)) and all(got[i][1] for i in range(300))


def test_quality_of_a_very_long_text_and_clashing_columns(spark):
    rows = [(1, "lorem ipsum dolor " * 200_000, "l", "s", 1, 2, "x"), (2, " ".join(f"w{i}" for i in range(300_000)), "l", "s", 1, 2, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, symbols long, outside string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert got[1].n_words == 600_000 and got[1].base_failed and got[2].n_words == 300_000 and got[2].n_repeat_words == 0 and got[2].kept


@pytest.mark.parametrize("text,want", [("a b c", 0), ("a b c a b c", 6), ("a a a a", 4), ("x a b c y a b c z", 6), ("a b a b a", 5), ("", 0)])
def test_repeated_words(text, want):
    own = text.encode().split()
    grams = Counter(tuple(own[i : i + 3]) for i in range(len(own) - 2))
    covered = {j for i in range(len(own) - 2) if grams[tuple(own[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    assert quality.repeated_words(own) == len(covered) == want


def brute_top(rows, k=5, every=50):
    use = [(n, i, np.array([math.floor(256 * x) for x in v], dtype=object)) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in use:
        if i % every == 0:
            best = sorted((-int(q @ p), j, m) for m, j, p in use if m != n and len(p) == len(q))[:k]
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(best, 1)]
    return sorted((i, r, j, max(-(2**63), min(2**63 - 1, s))) for i, r, j, s in out)


@pytest.mark.parametrize("kind", ["unit", "lengths", "copies", "odd", "dims", "1e7", "1e12", "1e15", "mixed"])
def test_top_k(spark, monkeypatch, kind):
    monkeypatch.setattr(topk, "BUCKET", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(400, 1)) * 1.5)
    if kind == "copies":
        x[100:300] = x[100]
    if kind[0] == "1":
        x *= float(kind)
    if kind == "mixed":
        x *= 10.0 ** rng.integers(-3, 15, size=(400, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    if kind == "dims":
        rows = [(i, v[: 1 + i % 7]) for i, v in rows]
    if kind == "mixed":  # of components whose squares no double holds, too
        rows += [(1000, [1e200] * 8), (1001, [-1e200] * 8), (1002, [1e7, 1.0] + [0.0] * 6)]
    if kind == "odd":
        rows += [(None, [1.0] * 8), (500, None), (550, []), (600, [float("nan")] * 8), (650, [None] * 8), (700, [1.0, 2.0]), (750, [2.0, -1.0]), (50, [0.0] * 8), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, norm long, uid string")
    got, want = sorted(tuple(r) for r in topk.top_k(docs).collect()), brute_top(rows)
    if kind == "mixed":  # beyond 2**126 scores are the greatest that the engine compares, and equal
        want = [r for r in want if r[0] != 1000]
        assert sum(r[0] == 1000 for r in got) == 5 and all(r[3] == 2**63 - 1 for r in got if r[0] == 1000)
        got = [r for r in got if r[0] != 1000]
        assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
        return
    assert got == want


def test_large_components(spark):
    rows = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 2.0]), (3, [3.0, 1e12])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=100).collect()
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(2, 2**16 * (10**14 + 2)), (1, 2**16 * (10**14 + 1)), (3, 2**16 * (3 * 10**7 + 10**12))]


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_chat(spark):
    put = json.dumps
    call = lambda i, name, args: put({"tool_calls": [{"id": i, "name": name, "arguments": args}]})
    tools = put({"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 1}}, "required": ["x"], "additionalProperties": False}}]})
    rows = [
        (1, 0, "system", tools), (1, 1, "tool", put({"tool_call_id": "a", "content": "3"})), (1, 2, "assistant", call("a", "f", {"x": 1})), (1, 3, "assistant", call("b", "f", '{"x": 0, "z": 1}')),
        (1, 4, "assistant", call("c", "g", {"k": {"$ref": "d"}})), (1, 5, "tool", put({"tool_call_id": "d", "content": {"b": 1, "a": 2}})), (1, 6, "assistant", call("d", "h", None)), (1, 7, "tool", put({"tool_call_id": "zz"})), (1, 8, "assistant", call("a", "f", {"x": 2})),
        (2, None, None, None), (2, 0, "user", "plain é \"text\"\n"), (2, 0, "user", "plain é \"text\"\n"), (None, 1, "user", "{broken"),
        (3, 0, "assistant", call("p", "f", {"k": {"$ref": "q"}})), (3, 1, "tool", put({"tool_call_id": "p"})), (3, 2, "assistant", call("q", "f", {"k": {"$ref": "p"}})), (3, 3, "tool", put({"tool_call_id": "q"})),
    ]
    got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"h": {"type": "null"}, "g": {"type": "object"}}).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)
    assert [r.turn for r in one] == [0, 2, 1, 3, 6, 5, 4, 7, 8] and [r.position for r in one] == list(range(9))
    links = {r.turn: (r.links, r.valid) for r in one}
    assert links[1] == ("linked", True) and links[3] == ("open", False) and links[7] == ("orphan", True) and links[8] == ("duplicate", True) and links[6] == ("linked", True)
    assert json.loads(one[3].line)["tool_calls"][0]["errors"] == ["/x: below minimum", "/z: unknown"]
    assert '"content":"{\\"a\\":2,\\"b\\":1}"' in one[5].line
    assert sum("cycle" in r.links for r in got if r.conv_id == 3) >= 1
    plain = sorted((r for r in got if r.conv_id == 2), key=lambda r: r.position)
    assert plain[0].line == '{"content":"plain é \\"text\\"\\n","role":"user"}' and plain[-1].role == "unknown"
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def brute_chat(rows):
    """(position, links) by row number, from the rules alone: messages are (conv, turn, calls [(id, refs)], result_of)."""
    turn_of = lambda i: 2**62 if rows[i][1] is None else rows[i][1]
    first, results = {}, {}
    for i in sorted(range(len(rows)), key=lambda i: (turn_of(i), i)):
        for k, (name, _) in enumerate(rows[i][2]):
            first.setdefault((rows[i][0], name), (i, k))
        if rows[i][3] is not None:
            results.setdefault((rows[i][0], rows[i][3]), []).append(i)
    waits, links = {}, {}
    for i, (conv, _, calls, of) in enumerate(rows):
        links[i] = ["duplicate" if first[conv, n] != (i, k) else "linked" if (conv, n) in results else "open" for k, (n, _) in enumerate(calls)]
        waits[i] = {j for _, refs in calls for r in refs if (conv, r) in first for j in results.get((conv, r), ())} - {i}
        if of is not None:
            links[i].append("linked" if (conv, of) in first else "orphan")
            if (conv, of) in first:
                waits[i] |= {first[conv, of][0]} - {i}
    place = {}
    while True:
        new = [i for i in waits if i not in place and all(j in place for j in waits[i])]
        if not new:
            break
        place |= {i: max([(turn_of(i), 0), *((place[j][0], place[j][1] + 1) for j in waits[i])]) for i in new}
    for i in waits:
        if i not in place:
            links[i].append("cycle")
    position = {}
    for conv in {r[0] for r in rows}:
        own = sorted((i for i in waits if rows[i][0] == conv), key=lambda i: (*place.get(i, (turn_of(i), 0)), turn_of(i), i))
        position |= {i: k for k, i in enumerate(own)}
        ordered = [i for i in own if i in place]
        assert all(position[j] < position[i] for i in ordered for j in waits[i])  # topological
    return position, {i: ",".join(x) for i, x in links.items()}


def random_chat(seed, n, convs, ids):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        conv, turn = int(rng.integers(convs)), None if rng.random() < 0.03 else int(rng.integers(n // 2))
        calls = [(f"i{rng.integers(ids)}", [f"i{rng.integers(ids)}" for _ in range(rng.integers(0, 3))]) for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append((None if conv == 0 else conv, turn, calls, f"i{rng.integers(ids)}" if rng.random() < 0.5 else None))
    return rows


@pytest.mark.parametrize("kind", ["cycles", "chains", "large groups", "many ranges"])
def test_chat_equals_brute_force(spark, monkeypatch, kind):
    rows = random_chat(1, 300, 12, 12) + random_chat(2, 300, 60, 400) if kind != "chains" else []
    if kind == "chains":  # every message waits for one of a later turn
        for conv in range(3):
            rows += [x for k in range(40) for x in ((conv, 100 - 2 * k, [(f"c{k}", [f"c{k - 1}"] if k else [])], None), (conv, 99 - 2 * k, [], f"c{k}"))]
    if kind == "large groups":
        monkeypatch.setattr(chat, "GROUP_EDGES", 3)
    if kind == "many ranges":
        monkeypatch.setattr(chat, "RANGE", 40)

    def text(calls, of):
        body = {"content": "x"} | ({"tool_calls": [{"id": i, "name": "f", "arguments": {"k": [{"$ref": r} for r in refs]}} for i, refs in calls]} if calls else {}) | ({"tool_call_id": of} if of else {})
        return json.dumps(body) if calls or of else "plain"

    table = [(c, t, str(k), text(calls, of)) for k, (c, t, calls, of) in enumerate(rows)]
    docs = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {int(r.role): (r.position, r.links) for r in chat.formatted(docs).collect()}
    position, links = brute_chat(rows)
    assert got == {i: (position[i], links[i]) for i in position}
    assert kind == "chains" or sum("cycle" in x for x in links.values()) > 20


def test_jobs_do_not_grow_with_waiting_messages(spark):
    put = json.dumps
    call = lambda i, ref: put({"tool_calls": [{"id": i, "name": "f", "arguments": {"$ref": ref}}]})

    def jobs(pairs):
        rows = [(0, 0, "a", call("self", "self")), (0, 1, "t", put({"tool_call_id": "self"}))]
        rows += [(1, -2 * k, "a", call(f"i{k}", f"i{k - 1}")) for k in range(pairs)] + [(1, -2 * k - 1, "t", put({"tool_call_id": f"i{k}"})) for k in range(pairs)]
        spark.sparkContext.setJobGroup(f"chat{pairs}", "")
        got = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.position)][:4] == [0, -1, -2, -3]
        assert sum("cycle" in r.links for r in got) == 2
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chat{pairs}"))

    assert jobs(120) <= jobs(6) + 40  # the rounds that connect a chain grow with the logarithm of its length


def test_json_of_any_depth_and_half_pairs(spark):
    deep = lambda n: "[" * n + "1" + "]" * n
    nest = lambda n: '{"a":' * n + "1" + "}" * n
    schema = '{"items":' * 3000 + '{"type":"string"}' + "}" * 3000
    rows = [
        (1, 0, "a", '{"tool_calls":[{"id":"x","name":"f","arguments":%s}]}' % deep(100_000)),
        (1, 1, "a", '{"tool_calls":[{"id":"y","name":"f","arguments":"%s"}]}' % nest(5000).replace('"', '\\"')),
        (1, 2, "t", '{"tool_call_id":"x","content":%s}' % nest(20_000)),
        (1, 3, "t", '{"tool_call_id":"y\\ud800","content":"a\\udc00b \\ud83d\\ude00"}'),
        (2, 0, "s", '{"tools":[{"name":"g","parameters":%s}]}' % schema),
        (2, 1, "a", '{"tool_calls":[{"id":"z","name":"g","arguments":%s}]}' % deep(3000)),
        (2, 2, "a", '{"tool_calls":[{"id":["q"],"name":{"n":1},"arguments":1e999}]}'),
        (2, 3, "u", "{" * 50_000), (2, 4, "u", '{"tool_calls": [' + "[" * 50_000),
        (2, 5, "u", "long " * 400_000),
    ]
    docs = spark.createDataFrame([(*r, 1, "x", None) for r in rows], "conv_id long, turn long, role string, text string, position long, line string, calls string")
    got = {(r.conv_id, r.turn): r for r in chat.formatted(docs).collect()}
    assert len(got) == len(rows)
    assert got[1, 0].links == "linked" and deep(100_000) in got[1, 0].line and nest(5000) in got[1, 1].line and got[1, 1].links == "open"
    assert got[1, 2].links == "linked" and json.loads(got[1, 2].line)["content"] == nest(20_000)
    assert json.loads(got[1, 3].line) == {"content": "a�b 😀", "link": "orphan", "role": "t", "tool_call_id": "y�"}
    assert not got[2, 1].valid and "not string" in got[2, 1].line
    assert '"id":"[\\"q\\"]"' in got[2, 2].line and '"arguments":null' in got[2, 2].line
    assert json.loads(got[2, 3].line)["content"] == "{" * 50_000 and json.loads(got[2, 5].line)["content"] == "long " * 400_000


@pytest.mark.parametrize("text", ['{"a": [1, 2.5, {"b": null}], "c": "x\\"{}[],:"}', "[]", "{}", " [ { } , [ ] ] ", '"x"', "-1.5e3", "[1,]", "[,1]", "{,}", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "[1]]", "[", "]", '{"a":1 "b":2}', "1 2", '{1:2}', "[tru]", '{"a":1,"a":2}', "", '["a"b]'])
def test_deep_reader_equals_the_librarys(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            chat._deep(text)
    else:
        assert chat._deep(text) == want and chat.canonical(want) == json.dumps(want, sort_keys=True, separators=(",", ":"))


@pytest.mark.parametrize("value,schema,n", [(1, {"type": "integer"}, 0), (True, {"type": "integer"}, 1), ("a", {"enum": ["a", 1]}, 0), ([1, "x"], {"items": {"type": "number"}}, 1), ({"a": 1}, {"required": ["b"]}, 1), (None, {"type": ["null", "string"]}, 0), ({"$ref": "x"}, {"type": "integer"}, 0), ("abc", {"maxLength": 2}, 1), (5, "not a schema", 0), (5, {"type": [["a"], {}]}, 1), ({}, {"required": [["a"]]}, 0)])
def test_schemas(value, schema, n):
    assert len(chat.faults(value, schema)) == n


def test_pipeline_equals_brute_force(spark, sf):
    """Each stage against its own rules, one after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {d.doc_id: d for d in docs.collect()}
    model = langid.fit(docs)
    for i in [i for i, d in kept.items() if model.predict(d.text)[0] == "und" or model.predict(d.text)[1] < 0.5]:
        del kept[i]
    c = duckdb.connect()
    import pyarrow as pa

    documents = pa.Table.from_pylist([d.asDict() for d in kept.values()])  # noqa: F841
    c.register("documents", documents)
    good = {r[0] for r in c.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    kept = {i: d for i, d in kept.items() if i in good}
    roots, _ = linked({i: d.text for i, d in kept.items()})
    kept = {i: d for i, d in kept.items() if roots[i] == i}
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(kept)
    assert len([n for n, _ in corpus_pipeline.STAGES]) == 4


@pytest.mark.parametrize("of", [lambda d: langid.filtered(d, 0.5), quality.filtered, neardup.deduplicated])
def test_filters_take_columns_of_any_names(of, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(80)
    docs = docs.union(docs.limit(2))  # ids that are not unique
    clashing = ["_id", "_n", "_h1", "_lang", "n_words", "symbols", "base_failed", "kept", "outside", "lang_pred", "score", "below_", "slot", "node", "component_id", "h1", "sig"]
    wide = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clashing)))
    got, plain = of(wide), of(docs)
    assert got.columns == wide.columns
    rows = got.collect()
    assert all([r[c] for c in clashing] == list(range(len(clashing))) for r in rows)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain.collect())


def test_pipeline_keeps_other_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    extra = docs.selectExpr("*", "1 as score", "'x' as lang_pred", "2 as n_words", "true as kept", "3 as h1", "null as component_id")
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, extra, sf)
        assert out.columns == extra.columns and out.schema["score"].dataType == extra.schema["score"].dataType
        assert f(spark, extra.where("false"), sf).collect() == []
    assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), sf).collect() == []
