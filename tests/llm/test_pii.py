import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import pii as P

from .helpers import awkward, frame, prose


def base(text):
    t = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m.group())) <= 15],
    ]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1@.+-% 90(b)2é\n", max_size=70))
def test_base_rules(text):
    assert P.base_spans(text) == base(text)


def test_long_runs_are_fast():
    for unit in ("a", "1", "1.", "@", "+1", "a@", "4 ", "+1 ("):
        P.base_spans(unit * 40_000)


def test_digest_query(spark, tmp_path):
    rng = random.Random(1)
    texts = dict(awkward(rng))
    for i in range(60):
        bits = ["joe.x@mail.example.com", "10.0.0.%d" % i, "4111 1111 1111 1111", "+1 (456) 555-21%02d" % i, "1.2.3.999", "4111111111111112"]
        texts[i] = prose(rng, 1) + " " + " ".join(rng.sample(bits, rng.randrange(0, 4))) + " ü " + prose(rng, 1)
    frame(spark, [*texts.items(), (5, texts[5])]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = P.op10_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        b = base(texts[r.doc_id])
        text = ",".join(f"{k}:{x}:{y}" for k, of in zip(P.KINDS, b) for x, y in of)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(k) for k in b]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(filter(None, r.spans.split(",")))


def test_bootstrap_finds_unseen_forms(spark):
    """Local numbers in the place of known phones are found; the same forms elsewhere are not."""
    rng = random.Random(2)
    texts = {}
    for i in range(40):
        texts[i] = f"{prose(rng, 1)} please call phone: +1 (456) 555-{1000 + i} today. {prose(rng, 1)}"
    for i in range(8):
        texts[100 + i] = f"{prose(rng, 1)} please call phone: 555-{2000 + i} today. {prose(rng, 1)}"
    for i in range(30):
        texts[200 + i] = f"{prose(rng, 1)} the part number 777-{3000 + i} fits. {prose(rng, 1)}"
    got = {r.doc_id: [e for e in r.extra or ()] for r in P.find_identifiers(frame(spark, texts)).collect()}
    for i, t in texts.items():
        if 100 <= i < 200:
            assert [t[e["start"] : e["end"]] for e in got[i]] == [f"555-{2000 + i - 100}"] and got[i][0]["kind"] == 3
        else:
            assert got[i] == []


def test_a_pattern_needs_support_and_share(spark):
    rng = random.Random(3)
    texts = {i: f"write to joe{i}@a.example now" for i in range(2)} | {10 + i: f"write to ann{i}(at)@x now" for i in range(3)}
    texts |= {20 + i: f"on page +1 456 555 10{10 + i} of" for i in range(4)} | {30 + i: f"on page 55512{10 + i} of" for i in range(40)}
    assert all(not r.extra for r in P.find_identifiers(frame(spark, texts)).collect())
    assert P.find_identifiers(frame(spark, {})).count() == 0
    del rng


def extras(spark, texts):
    rows = P.find_identifiers(frame(spark, texts)).collect()
    return {r.doc_id: sorted((texts[r.doc_id][e["start"] : e["end"]], e["kind"]) for e in r.extra or ()) for r in rows}


def test_known_numbers_are_found_without_their_base_form(spark):
    """A seed's digits elsewhere: bare, of 12 digits and more, punctuated, in groups, inside a longer run."""
    texts = {1: "call +1 555 123 4567 now", 2: "or +44 1234 567890, too"}
    texts |= {10: "ring 15551234567 or", 11: "x 441234567890 y", 12: "at 1-555-123-4567.", 13: "say (1) 555 123 4567", 14: "room 12 1 555 123 4567 9", 15: "no 15551234568 there", 16: "ends 1. 555 123 4567"}
    got = extras(spark, texts)
    assert got == {1: [], 2: [], 10: [("15551234567", 3)], 11: [("441234567890", 3)], 12: [("1-555-123-4567", 3)], 13: [("1) 555 123 4567", 3)], 14: [("1 555 123 4567", 3)], 15: [], 16: []}


def test_a_confident_pattern_finds_seeds_and_groups(spark):
    rng = random.Random(4)
    texts = {i: f"{prose(rng, 1)} please call phone: +1 (456) 555-{1000 + i} today. {prose(rng, 1)}" for i in range(40)}
    texts |= {100 + i: f"{prose(rng, 1)} please call phone: 1456555{1000 + i} today." for i in range(4)}
    texts |= {200 + i: f"{prose(rng, 1)} please call phone: 777 123 {2000 + i} today." for i in range(4)}
    texts |= {300 + i: f"{prose(rng, 1)} the lot 778 123 {2000 + i} fits." for i in range(9)}
    want = {i: [] for i in texts} | {100 + i: [(f"1456555{1000 + i}", 3)] for i in range(4)} | {200 + i: [(f"777 123 {2000 + i}", 3)] for i in range(4)}
    assert extras(spark, texts) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.+- 9()2\n", max_size=60))
def test_occurrences_lie_in_the_text(text):
    for a, b, value, seed, mask, _ in P.occurrences(text, P.base_spans(text)):
        assert 0 <= a < b <= len(text)
        if seed < 0 and mask & 12 and not mask & 2:
            assert value == re.sub("[^0-9]", "", text[a:b])


def test_long_tokens_take_linear_time():
    import time

    for text in ("a" * 10**6, "9" * 10**6, "a1" * 500_000, "x" * 10**6 + " +1 555 123 4567 " + "=" * 10**6, "1.2.3.4-" * 100_000, "a@b.cc/" * 100_000, "(" * 10**6 + "5", "1 " * 300_000, "=" * 10**6 + "4@4"):
        start = time.perf_counter()
        for _ in P.occurrences(text, P.base_spans(text)):
            pass
        assert time.perf_counter() - start < 5, text[:9]


def test_words_of_any_length_are_contexts(spark):
    """Patterns with long words, and long identifiers in their place."""
    far = "w" * 300
    texts = {i: f"so {far}: joe{i}@mail.example.com end" for i in range(9)} | {20: f"so {far}: {'ann' * 40}@localhost end"}
    got = extras(spark, texts)
    assert got == {i: [] for i in range(9)} | {20: [("ann" * 40 + "@localhost", 0)]}


def test_contexts():
    def at(text, part):
        a = text.index(part)
        return P.Contexts(text, [m.span() for m in P._TOKEN.finditer(text)]).at(a, a + len(part))

    assert at("call now: X9, please", "X9") == ["L call now:", "B now: _ please", "K now:"]
    assert at("a mailto:joe@x.de!", "joe@x.de") == ["L a mailto:", "K mailto:"]
    assert at('<a href="tel:55512">', "55512") == ["L href=\" tel:", "K tel:"]
    assert at("mail = joe@x.de ok", "joe@x.de") == ["B mail= _ ok", "K mail="]
    assert at("12345", "12345") == [] and at("(12345)", "12345") == []


def brute_bootstrap(occ):
    """The graph in dictionaries: occ has (value, seed, mask, patterns)."""
    import math

    edges, known, mask, bare = {}, {}, {}, {}
    for value, seed, m, patterns in occ:
        for p in patterns:
            edges.setdefault(p, set()).add(value)
        known[value] = max(known.get(value, -1), seed)
        mask[value] = mask.get(value, 0) | m
        bare[value] = bare.get(value, False) or seed < 0
    chance = {v: [float(s == k) for k in range(4)] for v, s in known.items()}
    accepted = -1
    while accepted != (accepted := sum(max(c) >= P.ACCEPT for c in chance.values())):
        conf = {}
        for p, values in edges.items():
            s = [sum(chance[v][k] >= P.ACCEPT for v in values) for k in range(4)]
            q = [x / (len(values) + 1) if x >= P.MIN_SUPPORT else 0.0 for x in s]
            conf[p] = [x if x >= P.PATTERN_CONFIDENCE else 0.0 for x in q]
        new = {}
        for v in chance:
            if known[v] >= 0:
                new[v] = chance[v]
                continue
            own = [p for p, values in edges.items() if v in values]
            vote = [1 - math.prod(1 - conf[p][k] for p in own) for k in range(4)]
            new[v] = [max(chance[v][k], vote[k]) if mask[v] >> k & 1 else 0.0 for k in range(4)]
        chance = new
    return {v: c.index(max(c)) for v, c in chance.items() if bare[v] and max(c) >= P.ACCEPT}


def test_bootstrap_against_brute_force(spark):
    """Random graphs in which discovered values make further patterns confident."""
    from pyspark.sql import functions as F

    for seed in range(3):
        rng = random.Random(seed)
        occ = []
        for _ in range(700):
            value, pattern = rng.randrange(80), rng.randrange(8)
            kind = value % 4 if pattern < 6 else rng.randrange(4)
            known = kind if value < 56 + 12 * (pattern < 3) and rng.random() < 0.9 else -1
            occ.append((f"v{value}", known, 1 << known if known >= 0 else rng.choice([1 << value % 4, 15]), [f"p{pattern * 4 + value % 4 if pattern < 6 else pattern}", f"q{rng.randrange(400)}"]))
        seeds = {v: k for v, k, _, _ in occ if k >= 0}
        occ = [(v, k if k < 0 else seeds[v], m if k < 0 else 1 << seeds[v], p) for v, k, m, p in occ]
        df = spark.createDataFrame(occ, "value string, seed int, mask int, patterns array<string>").withColumn("i", F.xxhash64("value"))
        names = {r.i: r.value for r in df.select("i", "value").distinct().collect()}
        got = {names[r.i]: r.kind for r in P.bootstrap(df).collect()}
        want = brute_bootstrap(occ)
        assert got == want and any(v not in seeds for v in want)


def test_numbers_of_many_groups_and_short_tokens():
    """As many groups as digits can make, and every form that a kind allows, however short."""
    text = "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now"
    found = {(text[a:b], k) for a, b, _, k, _, _ in P.occurrences(text, [[], [], [], []])}
    assert ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", -1) in found and ("1 1 1 1 1 1 1 1 1", -1) in found
    long = " ".join("1" * 30)
    spans = [b - a for a, b, *_ in P.occurrences(long, [[], [], [], []])]
    assert max(spans) == 2 * P.RUN_DIGITS[1] - 1 and min(spans) == 2 * P.RUN_DIGITS[0] - 1
    assert [(v, m) for _, _, v, _, m, _ in P.occurrences("at ::1 or 12 or a@b", [[], [], [], []])] == [("::1", 2), ("a@b", 1)]


def test_bootstrap_goes_on_until_nothing_is_new(spark):
    """A chain in which every round makes the next pattern confident; more links than any fixed number of rounds."""
    from pyspark.sql import functions as F

    links, width = 7, 6
    occ = [(f"v0_{j}", 3, 8, ["p0"]) for j in range(width)]
    for k in range(links):
        occ += [(f"v{k + 1}_{j}", -1, 8, [f"p{k}", f"p{k + 1}"]) for j in range(1)]
        occ += [(f"s{k}_{j}", 3, 8, [f"p{k + 1}"]) for j in range(2)] + [(f"s{k}_{j}", 3, 8, [f"p{k}"]) for j in range(8)]
    df = spark.createDataFrame(occ, "value string, seed int, mask int, patterns array<string>").withColumn("i", F.xxhash64("value"))
    names = {r.i: r.value for r in df.select("i", "value").distinct().collect()}
    got = {names[r.i] for r in P.bootstrap(df).collect()}
    assert got == set(brute_bootstrap(occ)) and {f"v{k + 1}_0" for k in range(links)} <= got
