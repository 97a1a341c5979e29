"""Licence templates, divergence of sources and filter interactions against brute force on small tables."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import divergence, filter_audit, licenses
from millrace.llm.license_templates import PHRASES, TEMPLATES

MIT = next(t for label, t in TEMPLATES if label == "mit")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def filled(template, options, draw):
    """A template's wording, with or without its optional regions."""
    out, depth, skip = [], 0, None
    at = 0
    for m in licenses.MARKUP.finditer(template):
        if skip is None:
            out.append(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            depth += 1
            skip = depth if skip is None and not options else skip
        elif m[1] == "endOptional":
            skip = None if skip == depth else skip
            depth -= 1
        elif skip is None and m[2]:
            out.append(" " + " ".join(f"some{draw.randrange(9)}" for _ in range(draw.randint(int(m[2]), int(m[3])))) + " ")
        elif skip is None:
            out.append(" " + draw.choice(m[4].split("|")) + " ")
    return "".join([*out, template[at:]])


def test_templates_are_found_with_and_without_their_regions(spark):
    draw = random.Random(1)
    rows, want = [], []
    for label, template in TEMPLATES:
        for options in (True, False):
            text = filled(template, options, draw)
            rows.append((len(rows), f"Before it. {text.upper()} and after it"))
            want.append(label)
            gone = text.split()
            gone[len(gone) // 2 :] = ["nonsense", *gone[len(gone) // 2 + 1 :]]
            rows.append((len(rows), " ".join(gone)))
            want.append(None)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    for i, label in enumerate(want):
        if label:
            assert label in got[i]["labels"].split(",") and got[i]["score"] == 1.0
    assert all("mit" not in got[i]["labels"] for i in (1, 3)) and got[1]["score"] == 0.0


def test_places_and_phrases_are_those_of_brute_force(spark):
    draw = random.Random(2)
    pool = "mit license apache general public gnu version 2 0 3 either the word License. MIT".split()
    rows = [(i, " ".join(draw.choices(pool, k=draw.choice([0, 3, 40, 200])))) for i in range(120)] + [(900, "mit licenſe MIT-LICENSE mit license2 é1 mit\x00license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for r in licenses.license_scan(df).collect():
        w = words(dict(rows)[r["doc_id"]])
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        line = f" {' '.join(w)} "
        more = {label for label, ask in (("apache-2.0", " apache license (version )?2 0 "), ("gpl-2.0", " gnu general public license (either )?version 2 "), ("gpl-3.0", " gnu general public license (either )?version 3 ")) if re.search(ask, line)}
        assert r["labels"] == ",".join(sorted({x for _, x in at} | more)) and r["score"] == (1.0 if more else 0.5 if at else 0.0)


def test_spans_and_a_small_state_table(spark, monkeypatch):
    wording = filled(MIT, False, random.Random(3))
    text = f"x y {wording} z {wording}"
    n = len(words(wording))
    monkeypatch.setattr(licenses, "MOST_STATES", 12)
    find = licenses.Automaton([MIT, 'a <<var;words="0..2">> b', 'a <<beginOptional>>c <<beginOptional>>d<<endOptional>> c<<endOptional>> b'])
    assert find.places(licenses.words_of(text.encode())) == [(0, 2, 2 + n), (0, 3 + n, 3 + 2 * n)]
    assert sorted(find.places(b"a a b".split())) == [(1, 1, 3), (2, 1, 3)]
    assert find.places(b"a x y b".split()) == [(1, 0, 4)] and find.places(b"a x y z b".split()) == []
    assert sorted(find.places(b"a c d c b".split())) == [(2, 0, 5)] and sorted(find.places(b"a c c b".split())) == [(1, 0, 4), (2, 0, 4)]
    for bad in ('<<var;words="1..2">> a', "<<beginOptional>> a", "a <<endOptional>>", ""):
        with pytest.raises(ValueError):
            licenses.parsed(bad)


def test_license_scan_of_odd_documents(odd, none):
    rows = licenses.license_scan(odd).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0.0 and r["labels"] == "" and r["first_word"] is None for r in rows)
    assert sorted(r["n_words"] for r in rows) == sorted(len(words(r["text"])) for r in odd.collect())
    assert licenses.license_scan(none).collect() == []


def brute_divergence(rows, least=3, ranks=200):
    term = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    rows = [(lang or "", source or "", term(text)) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs, counts = Counter(), defaultdict(Counter)
        for _, source, w in (r for r in rows if r[0] == lang):
            docs.update(set(w))
            counts[source].update(w)
        kept = {t for t, n in docs.items() if n >= least}
        whole = sum(counts.values(), Counter())
        rate = lambda c, t, v=len(kept), kept=kept: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + v)
        for a in counts:
            apart = lambda p, q: (p - q) ** 2 // q
            pairs = [(sum(apart(rate(counts[a], t), rate(counts[b], t)) for t in kept), b) for b in counts if b != a]
            terms = [(apart(rate(counts[a], t), rate(whole, t)), t) for t in kept if counts[a][t] and rate(counts[a], t) > rate(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, ranks)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, a, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def found_divergence(df, **more):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(df, **more).collect())


def documents_of_sources(seed):
    draw = random.Random(seed)
    pool = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopÄé"]
    rows = []
    for i in range(150):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s2", "s2", "s3", None, "é"])
        text = None if i % 17 == 0 else " ".join(draw.choices(pool, weights=range(1, len(pool) + 1), k=draw.choice([0, 5, 60])))
        rows.append((text, lang, source))
    return [*rows, ("Only-here only HERE", "xx", "alone"), (None, "en", "empty"), (rows[5][0], "en", "s1"), (rows[5][0], "en", "s1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_is_that_of_brute_force(spark, seed, monkeypatch):
    rows = documents_of_sources(seed)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "text string, lang string, source string, value long, item string").repartition(5)
    want = brute_divergence(rows)
    assert found_divergence(df) == want and any(r[2] == "term" for r in want)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(divergence, "ENTRIES_A_SHARD", 100)
    assert found_divergence(df, ranks=3) == brute_divergence(rows, ranks=3)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    rows = documents_of_sources(3)
    monkeypatch.setattr(divergence, "ENTRIES_HELD", 40)
    monkeypatch.setattr(divergence, "ROWS_OUT", 16)
    assert found_divergence(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)) == brute_divergence(rows)


def test_divergence_of_odd_documents(odd, none):
    assert found_divergence(odd) == brute_divergence([(r["text"], r["lang"], r["source"]) for r in odd.collect()])
    assert found_divergence(none) == []


def test_swaps_lead_through_all_orders():
    for n in range(6):
        order = list(range(n))
        seen = {tuple(order)}
        for i in filter_audit.swaps(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == len(list(filter_audit.swaps(n))) + 1


def brute_filters(rows, labels):
    text = lambda r: r[1] or ""
    fails = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text(r))
        fails.append({
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", text(r))) > 3 * len(text(r)),
            "D": bool(re.search("[#$%&*|]", text(r))),
            "E": r[0] is not None and any(x[0] is not None and x[0] < r[0] and text(x) == text(r) for x in rows),
        })
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, worth = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [k for k, r in enumerate(rows) if (r[2] or "") == part]
            every = list(left)
            for step, f in enumerate(order):
                gone = [k for k in left if fails[k][f]]
                redundant = sum(fails[k][f] for k in every) - len(gone)
                alone = sum(f == "".join(g for g in "ABCDE" if fails[k][g]) for k in every)
                left = [k for k in left if not fails[k][f]]
                out[part, "".join(order), step + 1] = f, len(left), len(gone), redundant, alone, sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)
                worth[part, f] += len(gone)
    return {(*k, *v, worth[k[0], v[0]]) for k, v in out.items()}


def found_filters(df, labels):
    return [(r["part"], r["filter_order"], r["step"], r["filter"], r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in filter_audit.filter_audit(df, labels).collect()]


def test_filter_audit_is_that_of_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(90):
        pool = draw.choice([["a", "b"], [f"w{k}" for k in range(500)], ["WORD", "Ünï", "x\xa0y", "tab\tbed"]])
        text = draw.choice([None, "", " ".join(draw.choices(pool, k=draw.choice([3, 199, 200, 260])))]) if i % 3 else " ".join(f"v{k}" for k in range(205))
        rows.append((draw.choice([i, i, 3, None]), text + draw.choice(["", "#", "\x1f"]) if text else text, draw.choice(["en", "de", None])))
    rows += rows[:7]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1])) for i in [*range(60), 3, 3]] + [(None, 1, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask long, part string").repartition(5)
    got = found_filters(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(got) == len(set(got)) == 3 * 600 and set(got) == brute_filters(rows, labels)


def test_filter_audit_of_odd_documents(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(found_filters(odd, labels)) == brute_filters([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [])
    assert found_filters(none, labels) == []


def test_any_number_of_filters(spark):
    cells = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 3, 2, 0, 1), ("q", 1, 4, 4, 4)], "part string, mask int, n long, good long, toxic long")
    got = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in filter_audit.interactions(cells, "xy").collect()}
    assert got["p", "xy", 1] == (5, 2, 0, 2) and got["p", "yx", 2] == (5, 0, 2, 2) and got["q", "yx", 2] == (0, 4, 0, 8) and len(got) == 8


def test_masks_count_bytes_as_they_are():
    assert filter_audit.text_mask(b"") == 1
    assert filter_audit.text_mask("É".encode() * 97 + b"ABC") == 1 and filter_audit.text_mask("É".encode() * 96 + b"ABC") == 5
    assert np.log2(filter_audit.REPEATED) == 4
