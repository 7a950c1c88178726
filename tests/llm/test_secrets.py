import base64
import math
import random
import re
import uuid

import pytest

from lodesearch.llm import secrets

from .conftest import CLASHES, odd_rows


def held_out():
    return secrets.examples(seed=99, n=60)


@pytest.fixture(scope="module", autouse=True)
def _trained(spark):
    secrets.scorer(spark)


def built_in():
    return secrets.scorer(None)


def flagged(strings):
    """Which of the strings have a credential in them."""
    s = built_in()
    good = s.credentials([x for x in strings if len(x) >= s.shortest], secrets.THRESHOLD, s.shortest)
    return [x for x in strings if x in good]


def test_held_out_accuracy():
    rows = [r for r in held_out() if len(r[2]) >= built_in().shortest]
    hits, others = ([r[2] for r in rows if r[1] == secret] for secret in (True, False))
    assert len(flagged(hits)) >= 0.99 * len(hits) and len(flagged(others)) <= 0.005 * len(others)


def test_ordinary_strings_of_other_makers():
    r = random.Random(17)
    words = "the quick brown fox jumps over lazy dog while seventeen engineers discuss whether memory bandwidth matters more than latency".split()
    sets = {
        "uuid": [str(uuid.UUID(int=r.getrandbits(128), version=4)) for _ in range(400)],
        "upper": [str(uuid.UUID(int=r.getrandbits(128), version=4)).upper() for _ in range(200)],
        "in a path": [f"/items/{uuid.UUID(int=r.getrandbits(128), version=4)}/{r.choice(words)}" for _ in range(200)],
        "encoded": [base64.b64encode(" ".join(r.choices(words, k=r.randint(3, 30))).encode()).decode() for _ in range(300)],
        "data": [base64.b64encode(r.randbytes(r.randint(80, 3000))).decode() for _ in range(100)],
        "repeat": [c * n for c in secrets.ALNUM for n in (20, 32, 40, 64, 1000)],
        "names": ["_".join(r.choices(words, k=r.randint(3, 9))) for _ in range(300)],
        "urls": ["www." + r.choice(words) + ".com/" + "/".join(r.choices(words, k=4)) + f"/{r.randint(1, 10**7)}.html" for _ in range(300)],
    }
    for name, own in sets.items():
        assert len(flagged(own)) < 0.01 * len(own), name


def test_likelihood_by_state():
    """Dense tables against the automata walked by hand: of whole runs of one token, and of the best explanation found by trying all."""
    rows = secrets.examples(seed=3, n=40)
    s = secrets.Scorer(rows)
    automata = {name: secrets.learned([r[2] for r in rows if (r[1], r[0]) == name and r[2]]) for name in s.names}
    for x in ["".join(random.Random(k).choices("0123456789abcdef", k=40)) for k in range(5)]:
        own = {name: secrets.likelihood(a, x) for name, a in automata.items()}
        best = max(p for n, p in own.items() if n[0])
        score = best - max(p for n, p in own.items() if not n[0])
        (_, _, kind, value, got), *_ = s.spans([x], -1e9, 40)[0]
        assert abs(value - best) < 1e-6 and abs(got - score) < 1e-6 and own[True, kind] == best
    ordinary = [a for (secret, _), a in automata.items() if not secret]
    for x in ("ab-12", "a.b/c", "x=9_y", "--a"):
        cuts = [p for p in range(1, len(x)) if x[p - 1] in secrets.SEPARATORS or x[p] in secrets.SEPARATORS]
        ways = [[0, *(c for k, c in enumerate(cuts) if m >> k & 1), len(x)] for m in range(1 << len(cuts))]
        want = max(sum(max(secrets.likelihood(a, x[u:z]) for a in ordinary) for u, z in zip(w, w[1:], strict=False)) for w in ways)
        assert abs(s.explained(x, [], 6.0)[0] - want) < 1e-6
        price = want - 50
        value, chosen = s.explained(x, [(cuts[0], len(x), "key", 0.0, 0.0)], price)
        assert chosen == [0] and value > want


def test_lengths_are_learned():
    for n in (32, 40):
        states = secrets.learned(["".join(random.Random(k).choices("0123456789abcdef", k=n)) for k in range(200)])
        assert len(states) == n + 1 and states[n][0] == 0 and all(end == secrets.UNKNOWN for end, _ in states[:n])


def test_merged_states_keep_frequencies():
    states = secrets.infer(["ab" * k for k in range(1, 60)])
    assert len(states) < 20
    for end, moves in states:
        assert abs(math.exp(end) + sum(math.exp(p) for _, p in moves.values()) - 1) < 0.01


def test_found_and_struck(documents, prose):
    r = random.Random(7)
    tokens = ["ghp_" + "".join(r.choices(secrets.ALNUM, k=36)), "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))]
    rows = [(1, f"{prose(1, 40)} key={tokens[0]} {prose(2, 40)} {tokens[0]}."), (2, f"id {tokens[1]}"), (3, prose(3, 200)), (4, "see /usr/share/documents/annotated and 2024-01-01T10 or -----------------------")]
    got = {(x.doc_id, x.secret): x.n for x in secrets.find_secrets(documents(rows, clashing=True)).collect()}
    assert {i for i, _ in got} == {1, 2} and sum(n for (i, _), n in got.items() if i == 1) == 2
    out = secrets.redact_secrets(documents(rows, clashing=True))
    texts = {x.doc_id: (x.text, x.n_chars) for x in out.collect()}
    assert not any(t in texts[i][0] for t in tokens for i in texts) and set(CLASHES) <= set(out.columns)
    assert all(len(t) == n for t, n in texts.values()) and texts[3][0] == rows[2][1] and texts[4][0] == rows[3][1]


def test_whole_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    s = built_in()
    want: dict = {}
    texts = docs.select("doc_id", "text").collect()
    for r in texts:
        for m in re.findall(rf"[A-Za-z0-9_\-+/=.]{{{s.shortest},}}", r.text, re.ASCII):
            for a, z, *_ in s.credentials([m], secrets.THRESHOLD, s.shortest).get(m, ()):
                want[r.doc_id, m[a:z]] = want.get((r.doc_id, m[a:z]), 0) + 1
    from lodesearch.llm.queries import QUERIES

    got = {(x.doc_id, x.secret): x.n for x in QUERIES["op10_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    assert got == want and want
    planted = {(r.doc_id, m) for r in texts for m in re.findall(r'(?i)token = "([0-9a-f]{40})"', r.text)}
    assert planted == got.keys()


def test_labelled_rows_replace_the_examples(spark, documents):
    r = random.Random(1)
    rows = [("pin", True, "PIN" + "".join(r.choices("0123456789", k=15))) for _ in range(200)] + [("word", False, "".join(r.choices("abcdefghij", k=18))) for _ in range(200)] + [(None, True, "x"), ("pin", None, "x"), ("pin", True, None)]
    labelled = spark.createDataFrame(rows, "kind string, secret boolean, credential string")
    docs = documents([(1, "PIN012345678901234 abcdefghijabcdefgh")])
    assert [x.secret for x in secrets.find_secrets(docs, labelled=labelled).collect()] == ["PIN012345678901234"]


def test_odd_rows_and_empty(documents, prose):
    rows = [*odd_rows(prose), (9, "A" * 100_000), (10, "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vX7zA9cE1gI3kM5")]
    assert {10} == {x.doc_id for x in secrets.find_secrets(documents(rows, clashing=True)).collect()}
    out = secrets.redact_secrets(documents(rows)).collect()
    assert len(out) == len(rows) and next(x.text for x in out if x.doc_id == 10) == secrets.REDACTED and next(x for x in out if x.doc_id == 2).text is None
    assert secrets.find_secrets(documents([])).isEmpty() and secrets.redact_secrets(documents([])).isEmpty()


def test_ids_of_other_types_and_ties(spark):
    key = "AKIA" + "Q" * 3 + "ZX7PL2MNB4VTR"
    docs = spark.createDataFrame([(str(uuid.UUID(int=5)), f"a {key} é {key}")], "doc_id string, text string")
    (row,) = secrets.find_secrets(docs).collect()
    assert (row.doc_id, row.secret, row.kind, row.n) == (str(uuid.UUID(int=5)), key, "aws_access_key", 2)
    # kinds that fit equally well: the first by name
    same = [(kind, True, "".join(random.Random(k).choices("0123456789", k=18))) for kind in ("b_pin", "a_pin") for k in range(100)] + [("word", False, "".join(random.Random(k).choices("abcdefghij", k=18))) for k in range(100)]
    found = secrets.find_secrets(spark.createDataFrame([(1, "123456789012345678")], "doc_id long, text string"), labelled=spark.createDataFrame(same, "kind string, secret boolean, credential string"))
    assert [x.kind for x in found.collect()] == ["a_pin"]


def test_credentials_behind_names_and_inside_long_runs(documents):
    r = random.Random(13)
    names = ["token", "client_secret", "session_token_secret", "authentication_token", "aws_secret_access_key", "export_the_secret_key", "TOKEN"]

    def path(k):
        return "/".join("".join(r.choices(secrets.SYLLABLES, k=4)) for _ in range(k))

    made: dict = {}
    for kind, secret, v in secrets.examples(seed=21, n=30):
        if secret:
            made.setdefault(kind, []).append(v)
    rows, want = [], {}
    for kind, own in made.items():
        for k, v in enumerate(own):
            name = names[k % len(names)]
            run = (f"{name}={v}", f"/srv/{name}/{v}/{path(1)}", f"{path(60)}/{v}/{path(60)}")[k % 3]
            want[len(rows)] = (kind, v)
            rows.append((len(rows), f"set {run} here"))
    rows.append((1000, f"{made['hex_40'][0]}.key/session_token={made['github_token'][0]}"))
    got: dict = {}
    for x in secrets.find_secrets(documents(rows)).collect():
        got.setdefault(x.doc_id, set()).add(x.secret)
    hits: dict = {}
    for i, (kind, v) in want.items():
        # a separator may be taken for the one at an end of the key, or the other way round
        hits.setdefault(kind, []).append(any(v.strip("/+") in x or x.strip("/+") in v for x in got.get(i, ())))
    assert all(sum(h) >= 0.96 * len(h) for h in hits.values()) and sum(map(sum, hits.values())) >= 0.98 * len(want)
    assert {made["hex_40"][0], made["github_token"][0]} <= got[1000]
    texts = {x.doc_id: (x.text, x.n_chars) for x in secrets.redact_secrets(documents(rows)).collect()}
    assert all(v[1:-1] not in texts[i][0] for i, (kind, v) in want.items() if kind != "base64_40" and i in got)
    assert all(len(t) == n and t.startswith("set ") and t.endswith(" here") for i, (t, n) in texts.items() if i < 1000)


def test_ordinary_runs_have_no_span(documents):
    long = "/".join(f"{a}{b}" for a in secrets.SYLLABLES for b in secrets.SYLLABLES)
    rows = [*enumerate(v for _, secret, v in held_out() if not secret), (10_000, long * 5), (10_001, "./" * 5000 + "z"), (10_002, "-" * 5000), (10_003, "a/" * 5000)]
    assert secrets.find_secrets(documents(rows)).count() <= 0.01 * len(rows)
