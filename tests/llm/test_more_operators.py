"""Alignment of tokenizers, quality rules and repair of conversations against brute force."""

import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import align, quality, repair

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WHITE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- alignment


def spans(tokens):
    at, out = 0, []
    for t in tokens:
        out.append((at, at + len(t)))
        at += len(t)
    return out


def alignments(rows):
    own, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    own.encode_special_tokens = True
    letters, names = align.byte_letters(), {i: t for t, i in own.get_vocab().items()}
    docs, held = [], collections.Counter()
    for i, t in rows:
        t = t or ""
        a, b = (own.encode(" " + t, add_special_tokens=False).ids, pieces.encode(t)) if t else ([], [])
        a_bytes = [bytes(letters[c] for c in names[x]) for x in a]
        b_bytes = [bytes.fromhex(pieces.id_to_piece(x)[3:5]) if pieces.is_byte(x) else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or {b"".join(a_bytes), b"".join(b_bytes)} != {(" " + t).encode()}:
            docs.append((i, 0, 0, 0, 0, [], ""))
            continue
        at_a, at_b = spans(a_bytes), spans(b_bytes)
        links = [(x, y) for x, (s, e) in zip(a, at_a, strict=True) for y, (u, v) in zip(b, at_b, strict=True) if s < v and u < e]
        groups, last = [], 0
        for end in sorted({e for _, e in at_a} & {e for _, e in at_b}):
            side = lambda ids, at: ",".join(str(x) for x, (s, e) in zip(ids, at, strict=True) if last <= s and e <= end)  # noqa: B023, E731
            groups.append(f"{side(a, at_a)}|{side(b, at_b)}")
            last = end
        held.update(set(links))
        docs.append((i, len(a), len(b), len(groups), len(links), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    return sorted(((*d[:5], sum(held[x] == most[x[0]] for x in d[5]), sum(held[x] for x in d[5]), d[6]) for d in docs), key=str)


def test_alignment(spark, monkeypatch):
    r = random.Random(1)
    rows = [(1, None), (2, ""), (3, " "), (None, "a b"), (4, "<|endoftext|> <s> ▁x"), (5, "a▁b"), (6, "日本語 текст 😀 é\x00x"), (7, "x" * 700), (8, "\n\n  two\t tabs\r\n"), (8, "\n\n  two\t tabs\r\n")]
    rows += [(10 + i, "".join(r.choice("ab cé1 '.\n😀 the") for _ in range(r.randint(0, 120)))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, chunk long, pair string").repartition(3)
    got = align.align(docs, A, B, contents=False)
    assert sorted((tuple(x) for x in got.collect()), key=str) == alignments(rows)
    assert got.columns == [x.split()[0] for x in align.RESULT.split(", ")]
    full = {x["doc_id"]: x for x in align.align(docs.where("doc_id in (3, 4, 6)"), A, B).collect()}
    assert full[3]["groups"] and all(sum(k["times"] for k in x["links"]) == x["n_links"] and sum(k["times"] * k["docs"] for k in x["links"]) == x["count_sum"] for x in full.values())
    assert align.align(docs.where("doc_id < 0"), A, B).count() == 0


def test_settled_characters_have_the_librarys_ids():
    own, t = Tokenizer.from_file(A), align.tokenizers(A, B)
    own.encode_special_tokens = True
    assert t.ranked and t.fast is not None
    for c in map(chr, range(0x250)):
        texts = [c, f" {c}", f"a{c}b 1{c}2 {c}{c} .{c}.", f"{c} {c}  {c}\n"]
        assert [x.tolist() for x in t.a(texts)] == [own.encode(x, add_special_tokens=False).ids for x in texts]


# ---------------------------------------------------------------- quality rules


def numbers(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen, covered = collections.defaultdict(list), set()
    for k in range(len(words) - 7):
        seen[tuple(words[k : k + 8])].append(k)
    for at in seen.values():
        if len(at) > 1:
            for k in at:
                covered.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def rejected(text):
    """The names of all rules that reject a text."""
    n, chars, symbols, dup, repeated = numbers(text)
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w], [x for x in text.split("\n") if x.strip(WHITE)]
    checks = {
        "few_words": n < 20,
        "repeated_words": 100 * repeated > 30 * n,
        "symbols": 100 * symbols > 10 * n,
        "word_length": not 2 * n <= chars <= 12 * n,
        "repeated_lines": 100 * dup > 30 * len(lines),
        "wordless": 100 * sum(not any(c.isalpha() for c in w) for w in words) > 40 * n,
        "shouting": 100 * sum(c.isupper() for c in text) > 50 * chars,
        "bullets": 100 * sum(x.lstrip(" ")[:2] in ("- ", "* ", "• ") for x in lines) > 90 * len(lines),
        "ellipses": 100 * sum(x.rstrip(" ").endswith(("...", "…")) for x in lines) > 30 * len(lines),
    }
    return {k for k, v in checks.items() if v}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = lambda k, n: " ".join(r.choice([f"word{i}" for i in range(k)]) for _ in range(n))
    good = [some(400, n) for n in (20, 21, 60, 300)]
    line = some(50, 12)
    bad = [None, "", " \n\t", "a b c", some(2, 40), "\n".join([line] * 5), "|".join(some(90, 60).split(" ")), " | ".join(some(90, 60).split(" ")), some(90, 30).upper(), "\n".join("- " + some(90, 9) for _ in range(6)), "\n".join(some(90, 9) + "..." for _ in range(6)), " ".join("12345" for _ in range(40)), " ".join(str(i) for i in range(40)), " ".join(f"w{i}" * 9 for i in range(30))]
    edges = [" ".join(f"w{i}" for i in [*range(8), *range(100, 120), *range(8)]), " ".join(f"w{i}" for i in [*range(10), *range(10), *range(200, 250)]), " ".join(["same"] * 9 + [f"w{i}" for i in range(60)]), some(30, 5000), "x" * 20000 + " " + some(900, 60)]
    return good + bad + edges + [some(r.randint(3, 60), r.randint(0, 120)) for _ in range(40)]


def test_quality(spark, texts):
    rows = [*enumerate(texts), (None, texts[2]), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_words long, words string, `a.b` long").repartition(3)
    got = quality.measured(docs).collect()
    want = []
    for i, t in rows:
        failed = rejected(t or "")
        want.append((i, *numbers(t or ""), bool(failed & set(quality.BASE)), not failed))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(x["kept"] for x in got) and {n for _, t in rows for n in rejected(t or "")} == {r.name for r in quality.RULES}
    kept = quality.kept(docs)
    assert kept.columns == docs.columns
    assert sorted(str((x["doc_id"], x["text"])) for x in kept.collect()) == sorted(str((i, t)) for i, t in rows if not rejected(t or ""))
    assert quality.measured(docs.where("doc_id < -1")).count() == 0 and quality.kept(docs.where("doc_id < -1")).count() == 0
    assert quality.measured(docs).where("kept and n_repeat_words < 5").count() == sum(w[7] and w[5] < 5 for w in want)


def test_quality_order(spark, texts):
    docs = spark.createDataFrame([(t or "",) for t in texts], "text string")
    cheap, dear = quality.Rule("cheap", ("n_words",), lambda n: n < 40), quality.Rule("idle", ("n_words", "n_repeat_words"), lambda n, r: F.lit(False))
    assert [r.name for r in quality.ordered(docs, [dear, cheap])] == ["cheap", "idle"]
    covered = quality.Rule("covered", ("n_words",), lambda n: n < 39)  # rejects nothing that the first one leaves
    assert [r.name for r in quality.ordered(docs, [dear, covered, cheap])].index("cheap") < 2
    for order in (quality.RULES, quality.RULES[::-1]):  # no verdict depends on the order
        by = {x["text"]: x["rejected_by"] for x in quality.cascade(docs, order).select("text", "rejected_by").collect()}
        for t, name in by.items():
            assert name == next((r.name for r in order if r.name in rejected(t)), None)


def test_quality_order_of_rules_that_reject_nothing_more(spark, monkeypatch):
    """A rule that others cover in the sample comes before one that never rejects, whatever was measured."""
    docs = spark.createDataFrame([("w " * n,) for n in (5, 60) * 10], "text string")
    idle = quality.Rule("idle", ("n_words",), lambda n: F.lit(False))
    cheap, covered = quality.Rule("cheap", ("n_words",), lambda n: n < 40), quality.Rule("covered", ("n_words",), lambda n: n < 39)
    marks = iter([t for seconds in (0.1, 0.2, 0.3, 0.5) for _ in range(2) for t in (0.0, seconds)])  # the scan, then each rule
    monkeypatch.setattr(quality.time, "perf_counter", lambda: next(marks))
    assert [r.name for r in quality.ordered(docs, [idle, covered, cheap])] == ["covered", "cheap", "idle"]


def test_quality_is_native(spark, texts):
    docs = spark.createDataFrame([(1, texts[0])], "doc_id long, text string")
    assert not re.search("Python|Arrow|Pandas", quality.measured(docs)._jdf.queryExecution().executedPlan().toString())


# ---------------------------------------------------------------- conversations


def repaired(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, messages) of each conversation, by trying all paths."""
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        own = by[c]
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            own += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    follows = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "3", ("3", "u"): "2"}
    out = {}
    for c, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        counts, seen, kinds = collections.Counter(), set(), []
        for _, role, text in own:
            kinds.append("blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
            counts[kinds[-1]] += 1
            seen.add((role, text))
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:], strict=False))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        best = {"0": (0, "", ())}

        def put(into, state, found):
            if state not in into or found[:2] < into[state][:2]:
                into[state] = found

        def inserts(into):
            for _ in range(4):
                for state, (cost, audit, said) in list(into.items()):
                    for role in ("user", "assistant"):
                        if (state, role[0]) in follows:
                            put(into, follows[state, role[0]], (cost + 3, audit + "I", (*said, (role, ""))))

        for (_, role, text), kind in zip(own, kinds, strict=True):
            inserts(best)
            new = {}
            for state, (cost, audit, said) in best.items():
                put(new, state, (cost + 4, audit + "D", said))
                if kind not in ("blank", "duplicate"):
                    more = cost + 3 * (kind == "truncated")
                    if (state, role[:1]) in follows:
                        put(new, follows[state, role[:1]], (more, audit + "K", (*said, (role, text))))
                    for r in ("user", "assistant"):
                        if (state, r[0]) in follows:
                            put(new, follows[state, r[0]], (more + 3, audit + "R", (*said, (r, text))))
            best = new
        inserts(best)
        cost, audit, said = min(best[s] for s in ("0", "3") if s in best)
        out[c] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, said)
    return out


def digest(said):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()


@pytest.fixture(scope="module")
def talk():
    r = random.Random(3)
    rows = []
    for c in [*range(160), None]:
        for t in range(400 if c == 77 else 150 if c is None else r.choice([1, 1, 2, 3, 5, 8, 12])):
            if r.random() > 0.05:
                role = r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "assistant"])
                rows.append((c, r.choice([t, t, t, t + r.randint(0, 3), None]), role, r.choice(["Hi.", "Well", "ok?", "  ", "", "x\ny!  \n", f"t{t}.", f"c{c} {t}.", None])))
    return rows


@pytest.mark.parametrize("options", [{}, {"long": 200, "block": 7}, {"long": 1, "block": 1}])
def test_repair(spark, talk, options):
    want = repaired(talk)
    rows = spark.createDataFrame([(*x, 1, "k") for x in talk], "conv_id long, turn long, role string, text string, part long, at string").repartition(5)
    got = {x[0]: tuple(x[1:]) for x in repair.audited(repair.damaged(rows), **options).collect()}
    assert got == {c: (*w[:7], digest(w[7])) for c, w in want.items()}
    said = collections.defaultdict(list)
    for x in repair.repaired(repair.damaged(rows), **options).collect():
        said[x["conv_id"]].append((x["nth"], x["edit"], x["role"], x["text"]))
    for c, w in want.items():
        assert tuple(x[2:] for x in sorted(said[c])) == w[7]
        assert "".join(x[1] for x in sorted(said[c])) == w[6].replace("D", "")


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.audited(repair.damaged(none)).count() == 0 and repair.repaired(none).count() == 0
    # rows that are all dropped leave their conversation with zeros
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = repair.audited(repair.damaged(spark.createDataFrame([(lost, 0, "user", "a.")], none.schema))).collect()
    assert [tuple(x) for x in one] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_ties_take_the_least_labels():
    x = repair.symbol("user", False, False)
    cost, labels = repair.finished(repair.shortest([x, x]))
    assert (cost, "".join(labels)) == (3, "KR")
    assert repair.finished(repair.shortest([repair.symbol("assistant", False, True)]))[0] == 4  # deleting it
    assert repair.finished(repair.shortest([])) == (0, [])
