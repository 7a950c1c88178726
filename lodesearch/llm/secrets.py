"""Credentials in texts, by probabilistic automata inferred from labelled examples.

For each kind of credential, and for each kind of ordinary string, an automaton is inferred from its examples by state merging
(the ALERGIA scheme): their prefix tree's states are merged in breadth-first order wherever Hoeffding's bound finds
their frequencies, and those of all their successors, compatible. Characters that the same bound can't tell apart in a kind's examples
(the sixteen of a hexadecimal key) may count as one symbol, so that a tree of random keys becomes one path and their length is learned;
a kind has such symbols if they make held-out examples likelier.

A candidate is a run of characters of credentials' alphabet that is at least as long as the shortest labelled credential. Every candidate
in every text is scored, whole: the automata are walked from each border of a token (a token is letters and digits between other
characters), and each border after it ends a span. A run with a span that is `threshold` nats likelier as a credential than
as an ordinary string is then segmented as a whole: its likeliest explanation by ordinary strings from border to border and
by those spans, each at a price of `threshold` nats. The spans in that explanation are the credentials, so a part of an
ordinary string (of a UUID, of encoded text) isn't taken for one, and several in one run are all found.

A walk ends once its characters are `HOPELESS` nats likelier under an ordinary automaton, or by chance: what comes after
them has walks of its own, from its own tokens.
"""

from __future__ import annotations

import base64
import math
import pickle
import random
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import spread
from .textscan import memo, pieces, text_bytes

ALPHA = 0.05
THRESHOLD = 6.0
EXAMPLES = 250
#: Labelled rows used of each kind by default, the least by hash; more are of no use to automata of this size.
MOST_EXAMPLES = 2000
UNSEEN = 1e-5
UNKNOWN = math.log(UNSEEN)
#: Many times what one unseen character costs, so a span that recovers from it has a part that scores more alone.
HOPELESS = 40.0
#: Examples that settle where a state belongs.
MANY = 50
#: Walks at a time, to bound memory.
WALKS = 1 << 14
#: Bytes of texts at a time.
PART = 1 << 20
REDACTED = "[REDACTED]"

ALNUM = string.ascii_letters + string.digits
SEPARATORS = "_-+/=."
CHARACTERS = ALNUM + SEPARATORS
CREDENTIALS = {
    "aws_access_key": [("AKIA", None, 0), ("", string.ascii_uppercase + string.digits, 16)],
    "github_token": [("ghp_", None, 0), ("", ALNUM, 36)],
    "slack_token": [("xoxb-", None, 0), ("", string.digits, 12), ("-", None, 0), ("", string.digits, 12), ("-", None, 0), ("", ALNUM, 24)],
    "stripe_key": [("sk_live_", None, 0), ("", ALNUM, 24)],
    "google_api_key": [("AIza", None, 0), ("", ALNUM + "_-", 35)],
    "hex_32": [("", "0123456789abcdef", 32)],
    "hex_40": [("", "0123456789abcdef", 40)],
    "hex_40_upper": [("", "0123456789ABCDEF", 40)],
    "hex_64": [("", "0123456789abcdef", 64)],
    "base64_40": [("", ALNUM + "+/", 40)],
    "json_web_token": [("eyJ", None, 0), ("", ALNUM + "_-", 30), (".eyJ", None, 0), ("", ALNUM + "_-", 60), (".", None, 0), ("", ALNUM + "_-", 43)],
}
SYLLABLES = "an ar be ber ca co de der die do el en er es ge ha he ie in ing is ja la le ly ment mi na no nt o on or ou pa que ra re ro sch se sh st ta te th the ti tion tra un ver wh".split()


def examples(seed: int = 10, n: int = EXAMPLES) -> list[tuple[str, bool, str]]:
    """(kind, whether it is a credential, string): labelled strings in published credential formats, and ordinary ones."""
    r = random.Random(seed)
    rows = [(kind, True, "".join(fixed + "".join(r.choice(chars) for _ in range(k)) if chars else fixed for fixed, chars, k in parts)) for kind, parts in CREDENTIALS.items() for _ in range(n)]

    def word():
        return "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 9)))

    def hexadecimal(k, chars="0123456789abcdef"):
        return "".join(r.choice(chars) for _ in range(k))

    for _ in range(n):
        w = word()
        rows += [("word", False, w), ("word", False, w.upper()), ("word", False, w.capitalize() + r.choice(["", "."]))]
        rows.append(("number", False, "".join(r.choice(string.digits) for _ in range(r.randint(5, 20)))))
        rows.append(("decimal", False, ".".join(str(r.randint(0, 99999)) for _ in range(r.randint(2, 4)))))
        rows.append(("date", False, f"{r.randint(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}" + r.choice(["", f"T{r.randint(0, 23):02}"])))
        rows.append(("name", False, r.choice("-_./").join(word() for _ in range(r.randint(2, 5)))))
        rows.append(("camel", False, "".join(word()[: r.randint(2, 12)].capitalize() for _ in range(r.randint(2, 7)))))
        rows.append(("numbered", False, word() + r.choice(["", "-", "_", "."]) + str(r.randint(0, 9999)) + r.choice(["", "." + word()])))
        rows.append(("path", False, r.choice(["/", ""]) + "/".join(word() for _ in range(r.randint(2, 5))) + r.choice(["", ".html", ".py", "/" + str(r.randint(1, 99999))])))
        rows.append(("rule", False, r.choice("-=_.+") * r.randint(5, 60)))
        rows.append(("separator", False, r.choice(SEPARATORS) * r.choice([1, 1, 1, 2])))
        for kind, chars in (("uuid", "0123456789abcdef"), ("uuid_upper", "0123456789ABCDEF")):
            rows.append((kind, False, "-".join([hexadecimal(8, chars), hexadecimal(4, chars), r.choice("1234457") + hexadecimal(3, chars), hexadecimal(4, chars), hexadecimal(12, chars)])))
    # text and data in base64; data are longer than any key
    for k in range(n // 5):
        text = " ".join(r.choice([word(), word(), word().capitalize(), word() + r.choice(".,"), str(r.randint(0, 999))]) for _ in range(r.randint(2, 12)))
        rows.append(("encoded_text", False, base64.b64encode(text[k % 3 :].encode()).decode()))
    rows += [("encoded_data", False, base64.b64encode(r.randbytes(30_000)).decode()) for _ in range(2)]
    for c in ALNUM:
        rows += [("repeat", False, c * r.randint(3, 60)) for _ in range(n // 10)]
    return rows


def different(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Whether Hoeffding's bound tells the two frequencies apart."""
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)


def infer(strings: list[str], alpha: float = ALPHA) -> list[tuple[float, dict[str, tuple[int, float]]]]:
    """States as (log-probability of ending, {character: (state, log-probability)}), the first one the start.

    A state is merged with that of the compatible ones under which what follows it is likeliest; if over MANY examples pass it, with the first.
    """
    few = 0.5 * math.log(2 / alpha)
    nxt: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    total, final = [0], [0]
    for s in strings:
        at = 0
        total[0] += 1
        for c in s:
            if c not in nxt[at]:
                nxt[at][c] = len(nxt)
                nxt.append({})
                count.append({})
                total.append(0)
                final.append(0)
            count[at][c] = count[at].get(c, 0) + 1
            at = nxt[at][c]
            total[at] += 1
        final[at] += 1

    def compatible(a: int, b: int) -> float | None:
        """The log-likelihood of what comes after b as it is after a, None if they differ."""
        waiting, evidence = [(a, b)], 0.0
        while waiting:
            a, b = waiting.pop()
            ta, tb, ca = total[a], total[b], count[a]
            if different(final[a], ta, final[b], tb, alpha):
                return None
            if final[b]:
                evidence += final[b] * math.log(max(final[a] / ta, UNSEEN))
            if tb > few:  # else no frequency of b's can differ from one of 0
                for c, k in ca.items():
                    if c not in count[b] and different(k, ta, 0, tb, alpha):
                        return None
            for c, k in count[b].items():
                f = ca.get(c, 0)
                if different(f, ta, k, tb, alpha):
                    return None
                if f:
                    evidence += k * math.log(f / ta)
                    waiting.append((nxt[a][c], nxt[b][c]))
                else:
                    evidence += UNKNOWN * sum(count[b].values())
        return evidence

    def fold(a: int, b: int) -> None:
        """Adds the tree under b to the automaton at a."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            total[a] += total[b]
            final[a] += final[b]
            for c, k in count[b].items():
                count[a][c] = count[a].get(c, 0) + k
                if c in nxt[a]:
                    waiting.append((nxt[a][c], nxt[b][c]))
                else:
                    nxt[a][c] = nxt[b][c]

    red = [0]
    blue = [(0, c) for c in sorted(nxt[0])]
    while blue:
        parent, c = blue.pop(0)
        b = nxt[parent][c]
        if b in red:
            continue
        fits = []
        for k, a in enumerate(red):
            if (evidence := compatible(a, b)) is not None:
                fits.append((evidence, -k))
                if total[b] > MANY:
                    break
        if fits:
            a = red[-max(fits)[1]]
            nxt[parent][c] = a
            fold(a, b)
        else:
            red.append(b)
        blue = [(p, c) for p in red for c in sorted(nxt[p]) if nxt[p][c] not in red]
    number = {state: k for k, state in enumerate(red)}
    out = []
    for state in red:
        whole = total[state]
        out.append((math.log(max(final[state] / whole, UNSEEN)), {c: (number[nxt[state][c]], math.log(k / whole)) for c, k in count[state].items()}))
    return out


def exchangeable(strings: list[str], alpha: float = ALPHA) -> dict[str, str]:
    """{character: the first of those that the bound can't tell from it}, by their frequencies and by what follows them, without the places
    at which most strings have the same character."""
    places: dict[int, Counter] = {}
    for s in strings:
        for k, c in enumerate(s):
            places.setdefault(k, Counter())[c] += 1
    fixed = {k for k, n in places.items() if 2 * max(n.values()) > len(strings)}
    n = sum((c for k, c in places.items() if k not in fixed), Counter())
    pairs = Counter(s[k : k + 2] for s in strings for k in range(len(s) - 1) if k not in fixed and k + 1 not in fixed)
    total = sum(n.values())

    def alike(x: str, y: str) -> bool:
        if different(n[x], total, n[y], total, alpha):
            return False
        return not any(different(pairs[a + a], n[a], pairs[a + b], n[a], alpha) for a, b in ((x, y), (y, x)))

    out: dict[str, str] = {}
    for c in sorted(set().union(*strings), key=lambda c: (not n[c], c)):  # those of fixed places only stay alone
        out[c] = next((x for x in dict.fromkeys(out.values()) if alike(x, c)), c) if n[c] else c
    return out


def automaton(strings: list[str], alpha: float, symbols: dict[str, str]) -> list[tuple[float, dict[str, tuple[int, float]]]]:
    """The inferred automaton with the characters of a symbol in proportion, but those that the bound tells apart in a state by their frequency there."""
    table = str.maketrans(symbols)
    n = Counter(c for s in strings for c in s)
    members: dict[str, list[str]] = {}
    for c in sorted(n):
        members.setdefault(symbols.get(c, c), []).append(c)
    states = infer([s.translate(table) for s in strings], alpha)
    if all(len(own) == 1 for own in members.values()):
        return states
    # all count alike within a symbol, but for what single states say
    seen: list[Counter] = [Counter() for _ in states]
    for s in strings:
        at = 0
        for c in s:
            seen[at][c] += 1
            at = states[at][1][symbols.get(c, c)][0]
    out = []
    for (end, moves), here in zip(states, seen, strict=True):
        own: dict[str, tuple[int, float]] = {}
        for x, (to, p) in moves.items():
            m, usual = sum(here[c] for c in members[x]), 1 / len(members[x])
            apart = {c: here[c] / m for c in members[x] if here[c] and abs(here[c] / m - usual) > math.sqrt(0.5 * math.log(2 / alpha) / m)}
            rest = len(members[x]) - len(apart)
            left = max(1 - sum(apart.values()), UNSEEN)
            for c in members[x]:
                own[c] = (to, p + math.log(apart.get(c) or left / rest))
        out.append((end, own))
    return out


def likelihood(states, s: str) -> float:
    at, total = 0, 0.0
    for c in s:
        at, p = states[at][1].get(c, (0, UNKNOWN))
        total += p
    return total + states[at][0]


def learned(strings: list[str], alpha: float = ALPHA) -> list[tuple[float, dict[str, tuple[int, float]]]]:
    """With symbols of one character, or of characters that are exchangeable: whichever, learned from one half of the strings, makes the other likelier."""
    symbols = exchangeable(strings, alpha)
    if all(a == b for a, b in symbols.items()):
        return automaton(strings, alpha, {})
    seen, unseen = strings[::2], strings[1::2]
    held = [sum(likelihood(a, s) for s in unseen) for a in (automaton(seen, alpha, x) for x in ({}, exchangeable(seen, alpha)))]
    return automaton(strings, alpha, symbols if held[1] > held[0] else {})


class Scorer:
    """All automata as dense tables over bytes, one below the other; `starts` has the first state of each."""

    def __init__(self, rows: list[tuple[str, bool, str]]):
        kinds: dict[tuple[bool, str], list[str]] = {}
        for kind, secret, s in rows:
            if s:
                kinds.setdefault((bool(secret), kind), []).append(s)
        self.set({key: (min(map(len, own)), learned(own)) for key, own in kinds.items()})

    def set(self, kinds: dict[tuple[bool, str], tuple[int, list]]) -> None:
        """kinds: the shortest example and the automaton of each (secret, kind)."""
        if not any(secret for secret, _ in kinds) or all(secret for secret, _ in kinds):
            raise ValueError("examples of credentials and of ordinary strings are needed")
        self.names = sorted(kinds)
        self.shortest = min(n for (secret, _), (n, _) in kinds.items() if secret)
        automata = [kinds[key][1] for key in self.names]
        sizes = [len(states) for states in automata]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = sum(sizes)
        self.to = np.repeat(self.starts, sizes)[:, None].repeat(128, 1)
        self.log = np.full((n, 128), UNKNOWN)
        self.end = np.array([end for states in automata for end, _ in states])
        for start, states in zip(self.starts, automata, strict=True):
            for k, (_, moves) in enumerate(states):
                for c, (state, p) in moves.items():
                    if ord(c) < 128:
                        self.to[start + k, ord(c)], self.log[start + k, ord(c)] = start + state, p
        # the ordinary automata stand first
        self.ordinary = sum(k for k, (secret, _) in zip(sizes, self.names, strict=True) if not secret)

    def spans(self, runs: list[str], threshold: float, shortest: int) -> dict[int, list[tuple[int, int, str, float, float]]]:
        """{run: (start, end, kind, log-likelihood, score)} of the spans over the threshold; of equal kinds the first by name. Runs are of ASCII."""
        raw = np.frombuffer("".join(runs).encode("ascii"), np.uint8)
        letter = np.zeros(128, bool)
        letter[[ord(c) for c in ALNUM]] = True
        lengths = np.array([len(s) for s in runs], np.int64)
        stop = np.cumsum(lengths)
        border = np.zeros(len(raw) + 1, bool)
        border[:-1] |= ~letter[raw]
        border[1:] |= ~letter[raw]
        border[0] = border[stop] = True
        opens = np.flatnonzero(border[:-1])
        owner = np.searchsorted(stop, opens, "right")
        some = stop[owner] - opens >= shortest
        opens, owner = opens[some], owner[some]
        secret = np.array([s for s, _ in self.names])
        kinds = np.flatnonzero(secret)
        found: dict[int, list[tuple[int, int, str, float, float]]] = {}
        chance = math.log(1 / len(CHARACTERS))
        for a in range(0, len(opens), WALKS):
            first, who = opens[a : a + WALKS], owner[a : a + WALKS]
            at, total = np.repeat(self.starts[:, None], len(first), 1), np.zeros((len(self.names), len(first)))
            k = 0
            while len(first):
                c = raw[first + k]
                total += self.log[at, c]
                at = self.to[at, c]
                k += 1
                if k >= shortest and (m := np.flatnonzero(border[first + k])).size:
                    whole = total[:, m] + self.end[at[:, m]]
                    best = kinds[whole[secret].argmax(0)]
                    value = whole[best, np.arange(len(m))]
                    score = value - whole[~secret].max(0)
                    for q in np.flatnonzero(score > threshold):
                        w = int(who[m[q]])
                        start = int(first[m[q]] - stop[w] + lengths[w])
                        found.setdefault(w, []).append((start, start + k, self.names[best[q]][1], float(value[q]), float(score[q])))
                least = np.maximum(total[~secret].max(0), chance * k) - HOPELESS
                on = (first + k < stop[who]) & (total[secret].max(0) > least)
                if not on.all():
                    first, who, at, total = first[on], who[on], at[:, on], total[:, on]
        return found

    def explained(self, run: str, spans: list[tuple[int, int, str, float, float]], price: float) -> tuple[float, list[int]]:
        """Log-likelihood of the likeliest way to write the run as ordinary strings from border to border and the given spans, at their price, and the spans in it."""
        to, log, end, heads = memo(("secret_lists", id(self)), self.ordinary_lists)
        n, raw = len(run), run.encode("ascii")
        ending: dict[int, list[int]] = {}
        for k, x in enumerate(spans):
            ending.setdefault(x[1], []).append(k)
        links: list[tuple[int, int]] = [(-1, 0)]  # (span, link before it)
        best = {0: (0.0, 0)}
        live: dict[int, tuple[float, int]] = {}  # state: its value and link
        for p in range(n + 1):
            if p:
                c, new = raw[p - 1], {}
                for at, (v, link) in live.items():
                    v += log[at][c]
                    at = to[at][c]
                    if at not in new or new[at][0] < v:
                        new[at] = (v, link)
                least = max(new.values())[0] - HOPELESS
                live = {at: x for at, x in new.items() if x[0] > least}
            if p in (0, n) or run[p - 1] in SEPARATORS or run[p] in SEPARATORS:
                if p:
                    now, link = max((v + end[at], link) for at, (v, link) in live.items())
                    for x in ending.get(p, ()):
                        before, old = best[spans[x][0]]
                        if (v := before + spans[x][3] - price) > now:
                            links.append((x, old))
                            now, link = v, len(links) - 1
                    best[p] = (now, link)
                for at in heads:
                    if at not in live or live[at][0] < best[p][0]:
                        live[at] = best[p]
        now, link = best[n]
        out = []
        while link:
            out.append(links[link][0])
            link = links[link][1]
        return now, out[::-1]

    def ordinary_lists(self):
        m = self.ordinary
        return self.to[:m].tolist(), self.log[:m].tolist(), self.end[:m].tolist(), self.starts[self.starts < m].tolist()

    def credentials(self, runs: list[str], threshold: float, shortest: int) -> dict[str, list[tuple[int, int, str, float]]]:
        """{run: (start, end, kind, score) of each credential in it, from left to right}. The score is the credential's log-likelihood less that of
        the likeliest ordinary explanation of its characters."""
        runs = sorted(set(runs))
        out = {}
        for k, own in self.spans(runs, threshold, shortest).items():
            run = runs[k]
            if run.isalnum():  # one token: the whole of it or nothing
                taken = [(a, z, kind, score) for a, z, kind, _, score in own]
            else:
                chosen = [own[x] for x in self.explained(run, own, threshold)[1]]
                taken = [(a, z, kind, value - self.explained(run[a:z], [], threshold)[0]) for a, z, kind, value, _ in chosen]
            if taken:
                out[run] = taken
        return out


def trained(labelled: DataFrame, most: int) -> Scorer:
    """Automata of (kind, secret, credential): each kind is learned by a task, from at most `most` of its rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("kind", "secret").orderBy(F.xxhash64("credential"), "credential")
    rows = labelled.select("kind", "secret", "credential").where("kind is not null and secret is not null and credential <> ''")
    rows = rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)

    def learn(t: pa.Table) -> pa.Table:
        strings = sorted(t.column("credential").to_pylist())
        random.Random(1).shuffle(strings)
        return pa.table({"kind": t.column("kind").slice(0, 1), "secret": t.column("secret").slice(0, 1), "states": [pickle.dumps((min(map(len, strings)), learned(strings)))]})

    # a partition a kind, as learning is dear and rows are few
    rows = rows.repartition(32, "kind", "secret")
    own = object.__new__(Scorer)
    own.set({(r.secret, r.kind): pickle.loads(r.states) for r in rows.groupBy("kind", "secret").applyInArrow(learn, "kind string, secret boolean, states binary").collect()})
    return own


def scorer(spark: SparkSession, labelled: DataFrame | None = None, most: int = MOST_EXAMPLES) -> Scorer:
    if labelled is not None:
        return trained(labelled, most)
    return memo("secret_scorer_trained", lambda: trained(spark.createDataFrame(examples(), "kind string, secret boolean, credential string"), 1 << 20))


def character_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in CHARACTERS]] = True
    return t


def candidates(data: np.ndarray, off: np.ndarray, i: int, j: int, shortest: int) -> tuple[np.ndarray, list[int], list[int], list[str]]:
    """The runs of at least `shortest` characters in texts i to j: their text, first and last + 1 byte and string."""
    x, first = data[off[i] : off[j]], off[i : j + 1] - off[i]
    inside = memo("secret_characters", character_table)[x]
    edge = np.zeros(len(x) + 1, bool)
    edge[first] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    long = end - start >= shortest
    start, end = start[long], end[long]
    raw = x.tobytes()
    text = np.searchsorted(first, start, "right") - 1 + i
    return text, (start + off[i]).tolist(), (end + off[i]).tolist(), [raw[a:z].decode("ascii") for a, z in zip(start.tolist(), end.tolist(), strict=True)]


def found_in(s: Scorer, column, threshold: float, shortest: int):
    """Yields (texts' bytes and offsets, [(text, first byte of the run, run, its credentials)]) by parts of the column."""
    data, off = text_bytes(column, lower=False)
    for i, j in pieces(off, PART):
        text, start, _, runs = candidates(data, off, i, j, shortest)
        good = s.credentials(runs, threshold, shortest)
        yield data, off, [(int(t), a, x, good[x]) for t, a, x in zip(text, start, runs, strict=True) if x in good]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: DataFrame | None = None, threshold: float = THRESHOLD, shortest: int | None = None, most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """(doc_id, secret, kind, score, n): each different credential of each document, with its number of places.

    doc_id has the type it has in docs. Rows with a null id or text have none, an empty table gives an empty result. Rows of one doc_id are
    taken together. Texts of any length are read whole, and so are runs. A kind is the first by name of those that fit equally well.
    shortest: the least length of a candidate, by default that of the shortest labelled credential. labelled (kind, secret, credential)
    replaces the built-in examples; rows with a null are left out, and at most most_examples of each kind are used. Other columns aren't read.

    What has the form of a labelled credential is one: digests of 40 or 64 hexadecimal digits (of commits, of files) can't be told from keys.
    UUIDs, encoded text and longer encoded data are ordinary.
    """
    own = scorer(docs.sparkSession, labelled, most_examples)
    least = own.shortest if shortest is None else shortest
    get = spread(docs.sparkSession, own)

    def run(batches):
        s = get()
        for b in batches:
            for _, _, found in found_in(s, b.column(1), threshold, least):
                rows = [(t, x[a:z], k, v) for t, _, x, own in found for a, z, k, v in own]
                if rows:
                    t, x, k, v = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(t)), pa.array(x), pa.array(k), pa.array(v)], ["doc_id", "secret", "kind", "score"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null and t is not null")
    return texts.mapInArrow(run, f"doc_id {kind}, secret string, kind string, score double").groupBy("doc_id", "secret", "kind", "score").agg(F.count("*").alias("n"))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", labelled: DataFrame | None = None, threshold: float = THRESHOLD, shortest: int | None = None, most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """All rows of docs with each credential in the text replaced by [REDACTED], and length_col, if there is one, made right, in one pass.

    Texts without one, empty and null texts stay as they are; other columns, and rows that repeat, are untouched. Texts of any length are read
    whole. An empty table gives an empty one. What counts as a credential is as in find_secrets.
    """
    own = scorer(docs.sparkSession, labelled, most_examples)
    least = own.shortest if shortest is None else shortest
    get = spread(docs.sparkSession, own)
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    marked = docs.withColumn(text_col, F.col(text_col).cast("string"))

    def run(batches):
        s = get()
        for b in batches:
            new: dict[int, bytes] = {}
            for data, off, found in found_in(s, b.column(at), threshold, least):
                struck: dict[int, list[tuple[int, int]]] = {}
                for t, start, _, own in found:
                    struck.setdefault(t, []).extend((start + a, start + z) for a, z, *_ in own)
                for t, spans in struck.items():
                    parts, done = [], int(off[t])
                    for a, z in spans:
                        parts += [data[done:a].tobytes(), REDACTED.encode()]
                        done = z
                    new[t] = b"".join([*parts, data[done : off[t + 1]].tobytes()])
            if not new:
                yield b
                continue
            columns = list(b.columns)
            texts = columns[at].to_pylist()
            for t, x in new.items():
                texts[t] = x.decode()
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if length_at is not None:
                lengths = columns[length_at].to_pylist()
                for t in new:
                    lengths[t] = len(texts[t])
                columns[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return marked.mapInArrow(run, marked.schema)
