import hashlib
import random
import re

from pointloom.llm import pii

from .conftest import ODD


def luhn(d):
    total = 0
    for k, c in enumerate(d[::-1]):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_formats_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789....@@a-+ () b%é٣²") for _ in range(rng.randrange(60)))
        assert pii.base_spans(t) == brute(t), t
    for t in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.c@d.e.f", "+1 (555) 123-4567", "+", "@", "0.0.0.0." * 50, "1" * 20000, "a." * 5000 + "@", "+1 (" * 3000):
        assert pii.base_spans(t) == brute(t)


def test_query_columns_and_odd_rows(odd, make):
    got = pii.extract_pii(odd).collect()
    assert len(got) == len(ODD)
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in got)
    assert pii.extract_pii(make([])).count() == 0
    r = pii.extract_pii(make([(1, "mail a.b@c.org from 10.0.0.1 or +49 (171) 123-4567")])).first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 0, 1)
    assert r["spans"] == "email:5:14,ip:20:28,phone:32:50"
    assert r["base_sha256"] == hashlib.sha256(r["spans"].encode()).hexdigest()


def test_patterns_discover_unseen_identifiers(make):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(k, f'some words token = "{key(39)}a1" and more {k}') for k in range(20)]
    rows += [(100, 'other words token = "QX-99-17-AB" here'), (101, "order 123456789 was sent"), (102, "room 20240101 is free")]
    got = {r["doc_id"]: r["spans"] for r in pii.extract_pii(make(rows)).collect()}
    assert got[100] == "key:21:32" and got[101] == got[102] == ""
    assert all(got[k].startswith("key:") for k in range(20))


def test_redaction(make):
    d = make([(1, "mail a.b@c.org now"), (2, None), (2, "clean"), (None, "10.0.0.1")]).selectExpr("*", "7 as row", "8 as spans")
    got = sorted(pii.redact(d).collect(), key=str)
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in got} == {(1, "mail [EMAIL] now", 16), (2, None, None), (2, "clean", 5), (None, "[IP]", 4)}
    assert pii.redact(d).columns == d.columns
    assert pii.replaced("abcdef", "ip:1:3,card:2:5") == "a[IP]f"


def test_kinds_go_through_the_graph_and_words_without_digits_are_candidates(make):
    rows = [(k, f"please call the desk at +49 (171) 555-{1000 + k} during the day, or write: user{k}@mail.example.org today") for k in range(12)]
    rows += [(100, "please call the desk at 555.12.EXT during the day"), (101, "or write: janeDoe_mailbox today"), (102, "a plain snake_case word and 20240101 too")]
    rows += [(200, "x" * 5000 + " " + "y" * 5000 + " desk at +49 (171) 555-7777 " + "z" * 9000)]
    got = {r["doc_id"]: (r["spans"], r["n_found"]) for r in pii.extract_pii(make(rows)).collect()}
    assert got[100] == ("phone:24:34", 1) and got[101] == ("email:10:25", 1) and got[102] == ("", 0)
    assert got[200][0] == "phone:10010:10028"


def test_contexts_of_any_length_are_told_apart():
    a, b = ("w" * 900 + c + " key: abc123" for c in "12")
    assert pii.candidates(a, [])[-1][2] != pii.candidates(b, [])[-1][2]
    assert pii._patterns("one two three abc123, four", 14, 21, "", ",") == ["< two three ", "> , four"]


def brute_scores(edges):
    score = {(p, i, k): 1.0 for p, i, n, k in edges if k}
    seeds, count = dict(score), {(p, i): n for p, i, n, _ in edges}
    for step in range(pii.ROUNDS):
        sure = {}
        for p in {p for p, *_ in edges}:
            for k in pii.KINDS + (pii.DISCOVERED,):
                own = [(score[p, i, k], n) for (q, i), n in count.items() if q == p and (p, i, k) in score]
                if sum(s >= 0.5 for s, _ in own) >= pii.LEAST_SEEDS:
                    sure[p, k] = sum(s * n for s, n in own) / (sum(n for (q, _), n in count.items() if q == p) + pii.SMOOTHING)
        if step == pii.ROUNDS - 1:
            out = {}
            for (p, k), s in sure.items():
                if s >= pii.CONFIDENT:
                    out[p] = max(out.get(p, (0, "")), (s, k))
            return out
        told = {}
        for p, i, *_ in edges:
            for k in pii.KINDS + (pii.DISCOVERED,):
                if (p, k) in sure:
                    told[i, k] = told.get((i, k), 1.0) * max(1e-6, 1 - sure[p, k])
        score = dict(seeds)
        for p, i, *_ in edges:
            for (j, k), rest in told.items():
                if i == j:
                    score[p, i, k] = max(score.get((p, i, k), 0.0), 1 - rest)


def test_scores_equal_a_plain_computation(spark, monkeypatch):
    from pointloom.llm._spark import Scratch

    rng = random.Random(9)
    edges = {}
    for _ in range(400):
        i = rng.randrange(60)
        edges[f"p{rng.randrange(25)}", i] = (rng.randrange(1, 6), None if i % 3 == 0 else ("email", "phone", "key")[i % 4 % 3])
    rows = [(p, i, n, k) for (p, i), (n, k) in edges.items()]
    monkeypatch.setattr(pii, "CONFIDENT", 0.4)
    got = {r["pattern"]: (r["sure"], r["kind"]) for r in pii.score_patterns(spark.createDataFrame(rows, "pattern string, instance long, n long, seed string"), Scratch(spark)).collect()}
    want = brute_scores(rows)
    assert len(want) >= 5 and set(got) == set(want)
    assert all(abs(got[p][0] - want[p][0]) < 1e-9 and got[p][1] == want[p][1] for p in want)
