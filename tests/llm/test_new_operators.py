"""Jaccard join, conversation repair and collocations against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loamline.llm import collocations, jaccard_join, turns
from loamline.llm.blocks import small_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, extra=False):
    small_batches(spark)
    rows = [(i, t, "x", 0) for i, t in (texts.items() if isinstance(texts, dict) else texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles string, component_id int")
    return df if extra else df.select("doc_id", "text")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


# --- n-gram Jaccard join -------------------------------------------------------------------------

def shingle_set(text):
    w = WORD.findall(ascii_lower(text or ""))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else zip(*(w[i:] for i in range(5))))


def brute_components(rows, percent):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        s, t = sets[i], sets[j]
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def similar_texts(seed):
    rng = random.Random(seed)
    rows, number = [], itertools.count(1)
    for _ in range(14):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 9, 30, 120, 400]))]
        for rate in (0, 0, 0.005, 0.01, 0.02, 0.04):
            copy = [f"e{rng.randrange(10 ** 6)}" if rng.random() < rate else w for w in base]
            cut = rng.randrange(0, max(1, len(copy) // 6)) if rng.random() < 0.4 else 0
            rows.append((next(number), " ".join(copy[cut:])))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  b"), (505, "b a"), (506, "x " * 3000),
             (507, "x " * 2000 + "y"), (3, rows[2][1]), (2, "one two three four five six seven")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_links_equal_all_pairs(spark, seed):
    rows = similar_texts(seed)
    got = jaccard_join.linked_components(docs_of(spark, rows, extra=True), percent=80)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 80)


def test_links_of_many_common_tokens(spark):
    """Boilerplate that all documents share, and a group of copies with one private word each."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, " ".join(common + [f"p{rng.randrange(10 ** 9)}" for _ in range(rng.randrange(4, 40))])) for i in range(60)]
    rows += [(100 + i, " ".join(common + [f"q{i}"])) for i in range(40)]
    got = jaccard_join.linked_components(docs_of(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 80)


def test_no_rows_link_nothing(spark):
    assert jaccard_join.linked_components(docs_of(spark, {})).count() == 0
    lone = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f")], "doc_id bigint, text string")
    assert {tuple(r) for r in jaccard_join.linked_components(lone).collect()} == {(None, 2, None), (4, 2, 4)}


def test_copies_in_one_batch_lose_no_link(spark):
    """Only one of equal rows brings its prefix; a row without an id before it must not be that one."""
    words = [f"w{i}" for i in range(60)]
    base, near, copied = " ".join(words), " ".join(words + ["more"]), " ".join(f"x{i}" for i in range(60))
    rows = [(None, base), (7, base), (9, base), (8, near), (None, near), (3, copied), (5, copied)]
    got = jaccard_join.linked_components(docs_of(spark, rows).coalesce(1))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect() if r["doc_id"] is not None) == [
        (3, 3), (5, 3), (7, 7), (8, 7), (9, 7)]


# --- conversation repair -------------------------------------------------------------------------

def cheapest(rows):
    """(cost, audit, repaired rows) by dynamic programming over whole strings."""
    def sound(initials):
        return re.fullmatch("(s?(ua)+)?", initials) is not None

    # Paths by (what was written last); every path is kept as (cost, audit, rows) and the least wins.
    def step(state, initial):
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        return initial if initial and initial in follow else None

    def inserts(states):
        for _ in range(2):
            for state, (cost, audit, out) in list(states.items()):
                for role in ("user", "assistant"):
                    to = step(state, role[0])
                    if to:
                        new = (cost + 5, audit + "I", out + [(role, "")])
                        if to not in states or new[:2] < states[to][:2]:
                            states[to] = new
        return states

    states = inserts({"": (0, "", [])})
    for role, text, fault in rows:
        found = {}

        def offer(to, new):
            if to is not None and (to not in found or new[:2] < found[to][:2]):
                found[to] = new

        for state, (cost, audit, out) in states.items():
            offer(state, (cost + 2, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            offer(step(state, role[:1]), (cost + more, audit + "K", out + [(role, text)]))
            for given in ("user", "assistant"):
                offer(step(state, given[0]), (cost + more + 1, audit + "R", out + [(given, text)]))
        states = inserts(found)
    cost, audit, out = min((v for k, v in states.items() if k in ("", "a")), key=lambda v: v[:2])
    assert sound("".join(r[0] for r, _ in out))
    return cost, audit, out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        if not solid:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_repair(rows):
    """The contract's row of every conversation, from undamaged (conv_id, turn, role, text)."""
    kept = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = kept[conv]
        if kind == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        mine += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns_ = [t for t, _, _ in mine if t is not None]
        marked = faults([(r, t) for _, r, t in mine])
        cost, audit, repaired = cheapest(marked)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        count = collections.Counter(f for _, _, f in marked)
        body = "\n".join(f"{r}:{t}" for r, t in repaired)
        out.append((conv, max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0, count["blank"], count["duplicate"],
                    count["truncated"], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def talk(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None])
            text = rng.choice(["Yes.", "No", "ok?", "", " \t", "Yes.", "done!", "ask \n", None, f"t{rng.randrange(9)}."])
            rows.append((conv, turn if rng.random() < 0.9 else None, role, text))
    rows += [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (900, None, None, None)]
    rows += [(901, t, "user" if t % 2 == 0 else "assistant", f"row {t}.") for t in range(900)]
    rows += [(902, t, "user", "same.") for t in range(300)] + [(903, t, "user", f"only {t}.") for t in range(200)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repairs_equal_a_plain_search(spark, seed):
    rows = talk(seed)
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, role string, text string, copy int")
    got = turns.digests(turns.damage(df.repartition(5))).collect()
    want = brute_repair(rows)
    assert sorted(map(tuple, got), key=lambda r: (r[0] is not None, r[0] or 0)) == want


def test_edits_give_sound_conversations(spark):
    df = spark.createDataFrame(talk(3, 40), "conv_id bigint, turn bigint, role string, text string")
    out = collections.defaultdict(str)
    for r in turns.edits(df).orderBy("conv_id", "step").collect():
        if r["edit"] != "D":
            out[r["conv_id"]] += r["role"][0]
    assert all(re.fullmatch("s?(ua)+", v) for v in out.values()) and len(out) > 20


def test_memory_follows_what_is_unresolved():
    """A long sound conversation leaves no tree behind; one that stays undecided keeps its suffix only."""
    final = []
    rows = turns.Conversation(final.append)
    for t in range(5000):
        rows.row(t, "user" if t % 2 == 0 else "assistant", f"t{t}.", 1)
        assert t - len(final) < 20
    assert rows.end() == 0 and "".join(e[0] for e in final) == "K" * 5000


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert turns.digests(turns.damage(none)).count() == 0 and turns.edits(none).count() == 0


# --- collocations --------------------------------------------------------------------------------

def brute_phrases(rows, shortest=2, longest=3, least=10, cover=50, first=2000):
    total, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", ascii_lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f[lang].update(zip(*(w[i:] for i in range(n))))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if shortest <= len(p) <= longest and a >= least}
        beaten = collections.Counter()
        for p, a in cand.items():
            for m in range(shortest, len(p)):
                for j in range(len(p) - m + 1):
                    beaten[p[j:j + m]] = max(beaten[p[j:j + m]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * beaten.get(p, -1) >= cover * a and p in beaten:
                continue
            score, _, l, r = min((10 ** 6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            rows_.append((score, a, " ".join(p), l, r))
        rows_.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, l, r, total[lang], s) for i, (s, a, p, l, r) in enumerate(rows_[:first])]
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(120):
        n = rng.choice([0, 1, 5, 60, 300])
        w = [rng.choice(["of", "the", "New", "york", "city", "été", f"w{rng.randrange(60)}"]) for _ in range(n)]
        rows.append((rng.choice(["en", "fr", None, "und"]), "".join(x + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\n"]) for x in w)))
    copy = "the quick brown fox jumps over the lazy dog and runs on " * 9
    rows += [("en", copy)] * 7 + [("fr", None), ("fr", ""), ("xx", "lone"), ("yy", "a b " * 4), ("en", "z " * 4000), ("en", "p q r, " * 30)]
    return rows


@pytest.mark.parametrize("options", [{}, {"longest": 4, "least": 4, "cover": 80, "first": 40, "period": 4}, {"longest": 2, "period": 1}])
def test_phrases_equal_plain_counts(spark, options):
    rows = phrase_rows(7)
    df = small_batches(spark).createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, rank int, phrase string")
    got = collocations.mine(df.repartition(3), **options)
    want = brute_phrases(rows, **{k: v for k, v in options.items() if k != "period"})
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "_BITS", 64)
    rows = phrase_rows(8)
    df = small_batches(spark).createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, collocations.mine(df).collect())) == brute_phrases(rows)


def test_chunks_own_every_word_once(spark):
    rows = phrase_rows(9)
    df = small_batches(spark).createDataFrame(rows, "lang string, text string")
    owned = {r["lang"]: r["n"] for r in collocations.parse(df, 3).groupBy("lang").agg(F.sum("owned").alias("n")).collect()}
    want = collections.Counter()
    for lang, text in rows:
        want[lang or "und"] += len(re.findall(r"[^\x20\x09-\x0D.,;:!?]+", text or ""))
    assert owned == {k: v for k, v in want.items() if v}


def test_no_texts_no_phrases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(none).count() == 0
