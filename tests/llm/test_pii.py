import random
import re

from pyspark.sql import functions as F

from helmwatch.llm import pii


def brute(text):
    """The contract's expressions, applied as they stand."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


HARD = ["a@b@c.d e@f.g@h.i-j.k", "@x.y a@b. .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (473) 555-8136 +123 +1-2.3(4)5 6 7 8 9 0", "é+1 (473) 555-8136é", "", "a" * 5000 + "@", "1" * 6000 + "." + "2" * 5000]


def test_base_spans_equal_the_expressions(documents):
    for text in [*HARD, *(t or "" for _, t in documents)]:
        assert pii.base_spans(text) == brute(text), text[:80]


def test_patterns_find_values_of_no_known_shape(spark):
    rows = [(i, f"word password={i:018x}a1 tail", "x") for i in range(16, 36)] + [(100, "so password=hunter-two, then", "x"), (101, "ratio: nothing here", "x"), (102, None, "x"), (102, None, "x")]
    out = {r["doc_id"]: r["spans"] for r in pii.find_identifiers(spark.createDataFrame(rows, "doc_id long, text string, kind string")).collect()}
    assert [(s["kind"], s["start"], s["end"]) for s in out[100]] == [(4, 12, 22)]
    assert out[101] == [] and out[102] == []


def test_query_matches_brute_force(spark, docs, documents):
    got = {r["doc_id"]: r for r in pii.find_identifiers(docs).withColumn("n", F.size("base")).collect()}
    assert len(got) == len(documents)
    for i, t in documents:
        assert [(x["start"], x["kind"], x["end"]) for x in got[i]["base"]] == brute(t or "")
        assert {(x["start"], x["kind"]) for x in got[i]["base"]} <= {(x["start"], x["kind"]) for x in got[i]["spans"]}


def test_masking_keeps_rows_and_columns(spark):
    rows = spark.createDataFrame([(1, "mail me@ex.org now", 7), (2, None, 8), (3, "clean", None)], "doc_id long, text string, spans int")
    out = pii.mask_identifiers(rows)
    assert out.columns == ["doc_id", "text", "spans"]
    assert {(r["doc_id"], r["text"], r["spans"]) for r in out.collect()} == {(1, "mail [EMAIL] now", 7), (2, None, 8), (3, "clean", None)}
    assert pii.mask_identifiers(rows.where("false")).count() == 0


def spans_of(spark, texts):
    out = pii.find_identifiers(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    return {r["doc_id"]: [(texts[r["doc_id"]][x["start"] : x["end"]], x["kind"]) for x in r["spans"]] for r in out}


def test_found_values_are_seeds_of_the_next_round(spark):
    plain = ["hunter-two", "tree.house", "qwerty-x", "sesame-open", "blue-moon"]
    texts = [f"word password={i:018x}a1 tail" for i in range(16, 36)]
    texts += [f"so password={v} then" for v in plain] + [f"old passwd: {v} there" for v in plain] + ["old passwd: zebra-nine there", "colour: zebra-nine too"]
    out = spans_of(spark, texts)
    assert out[len(texts) - 2] == [("zebra-nine", 4)]


def test_words_around_seeds_are_patterns(spark):
    texts = [f"number {i} of them: please write to user{i}@ex.org before noon and {i} more" for i in range(10)]
    texts += ["You may please write to agent_smith before dawn", "we will not write to anyone", "He saw agent_jones before noon and left", "nothing here"]
    out = spans_of(spark, texts)
    assert out[10] == [("agent_smith", 4)] and out[12] == [("agent_jones", 4)]
    assert out[13] == []


def test_places_of_contexts_are_those_of_all_slots(documents):
    for text in (t or "" for _, t in documents[:200]):
        slots = [(c, a, b) for *sides, a, b, _ in pii._slots(text, []) for c in sides if any(c[1:])]
        contexts = frozenset(c for c, _, _ in slots[::7])
        assert sorted(pii._plain_slots(text, contexts, frozenset(c[1:] for c in contexts))) == sorted(x for x in slots if x[0] in contexts)


def test_long_values_and_cues_are_found_whole(spark):
    long, cue = "Ab9-" * 75, "a_very_long_name_of_a_field_for_tokens"
    texts = [f"word {k}={i:018x}a1 tail" for k in ("token", cue) for i in range(16, 36)]
    texts += [f"so token={long} then", f"so {cue}={long} then", "so token=me@x.org!Qq9 then"]
    out = spans_of(spark, texts)
    assert out[40] == [(long, 4)] and out[41] == [(long, 4)]
    assert out[42] == [("me@x.org", 0), ("!Qq9", 4)]


def test_masking_keeps_repeated_rows_and_clashing_columns(spark):
    secret = "Zz8-" * 250
    rows = [(i, f"word password={i:018x}a1 tail", 1, "x", 2, None) for i in range(16, 36)]
    rows += [(1, f"so password={secret} then", 1, "x", 2, None)] * 3 + [(1, "another text me@ex.org", 1, "x", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _masked int, _id string, id int, spans string")
    out = pii.mask_identifiers(docs)
    assert out.columns == docs.columns
    assert sorted(r["text"] for r in out.where("doc_id = 1").collect()) == ["another text [EMAIL]", *["so password=[SECRET] then"] * 3]
    assert out.count() == 24


def graph(edges, rounds=pii.ROUNDS):
    """Trusted patterns of edges (pattern, value) -> seed, scored one by one."""
    score, seed = dict(edges), dict(edges)
    patterns = {p for p, _ in edges}
    of = lambda p, table: [x for (q, _), x in table.items() if q == p]
    for _ in range(rounds):
        trust = {p: sum(of(p, score)) / len(of(p, score)) for p in patterns if sum(of(p, seed)) >= pii.MIN_SEEDS}
        best, seeded = {}, {}
        for (p, v), s in edges.items():
            best[v] = max(best.get(v, 0.0), trust.get(p, 0.0))
            seeded[v] = max(seeded.get(v, 0.0), float(s), float(trust.get(p, 0.0) >= pii.MIN_CONFIDENCE))
        seed = {(p, v): seeded[v] for p, v in edges}
        score = {(p, v): max(seeded[v], best[v] / 2) for p, v in edges}
    return {p for p in patterns if sum(of(p, seed)) >= pii.MIN_SEEDS and sum(of(p, score)) / len(of(p, score)) >= pii.MIN_CONFIDENCE}


def test_trusted_patterns_match_brute_force(spark):
    rng = random.Random(4)
    edges = {}
    for p in range(40):
        share = rng.random()
        for v in rng.sample(range(120), rng.randint(2, 15)):
            edges[f"p{p}", f"v{v}"] = v % 3 == 0 and rng.random() < share or (p < 8 and rng.random() < 0.8)
    seen = spark.createDataFrame([(p, v, s) for (p, v), s in edges.items() for _ in range(2)], "pattern string, value string, seed boolean")
    got = {r["pattern"] for r in pii.trusted_patterns(seen).collect()}
    assert got == graph(edges) and 0 < len(got) < 40


def test_added_spans_equal_the_plain_way():
    rng = random.Random(6)
    for _ in range(300):
        base = sorted((s := rng.randint(0, 60), rng.randint(0, 3), s + rng.randint(1, 9)) for _ in range(rng.randint(0, 6)))
        found = [(s := rng.randint(0, 60), s + rng.randint(1, 15)) for _ in range(rng.randint(0, 8))]
        covered = {i for s, _, e in base for i in range(s, e)}
        parts = set()
        for s, e in found:
            inside = [i for i in range(s, e) if i not in covered]
            for i in inside:
                if i - 1 not in inside:
                    end = next(j for j in range(i, e + 1) if j not in inside)
                    parts.add((i, end))
        want = sorted((a, 4, b) for a, b in parts if not any((x, y) != (a, b) and x <= a and y >= b for x, y in parts))
        assert pii.added_spans(base, found) == want
