import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwave.llm import pii

from .fixtures import frame, prose

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab.@-_%+0123456789 ()é"), max_size=60))
def test_base_spans(text):
    assert pii.find_base(text) == brute(text)


def test_query_has_the_columns_of_its_contract(spark, tmp_path):
    import hashlib

    from tarnwave.llm import queries

    card = "411111111111111" + pii.luhn_check_digit("411111111111111")
    texts = [f"{card} then 10.0.0.1", "1.2.3.4 5.6.7.8.9.10.11.12 300.1.1.1", "call +1 (555) 010-9999 or a@b.co, c@d.org", "+49 30 1234567", None, "", f"é\U0001f642 x@y.zz {card}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        spans, r = brute(text or ""), got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in spans) for kind in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    assert len(got) == len(texts)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("0123456789"), min_size=13, max_size=17))
def test_cards(digits):
    card = digits + pii.luhn_check_digit(digits)
    assert (0, 2, len(card)) in pii.find_base(card)


def test_long_runs_are_linear():
    long = "a" * 200_000 + "1" * 1_000_000 + "." + "+" * 1000 + "1 " * 100_000 + "+1" + "(" * 100_000
    assert pii.find_base(long) == brute("1 " * 3 + "+1" + "(" * 9) == [] and pii.secrets(long, 64) == []


def test_secrets():
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    text = f'token = "{key}" and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 or justalongwordwithoutanydigits'
    assert [text[a:b] for a, _, b in pii.secrets(text, 64)] == [key]
    assert pii.clean_text(text, *pii.found_in(text, pii.PiiRules(), {})).startswith('token = "[SECRET]" and')


def test_disclosures_against_brute_force(spark):
    import math
    import random
    import re
    from collections import defaultdict

    r = random.Random(4)
    names = ["Annorst", "Belwin", "Corvath", "dermit", "elost"]
    rows = []
    for i in range(120):
        t = prose(i, 12)
        for _ in range(r.randrange(3)):
            j = r.randrange(4)
            t += f" {r.choice(names[j : j + 2])} {prose(i + 7, 1)} u{j}@mail{j % 2}.example.org, " + prose(r.randrange(99), 6)
        rows.append((i, t))
    rows += rows[:5] + [(None, rows[9][1]), (200, None)]
    rules = pii.PiiRules(support=2, beyond=0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x["entity"], x["term"]): x["disclosure"] for x in pii.disclosures(docs, pii.mentions(docs, rules), rules).collect()}
    near, ent, term = defaultdict(list), defaultdict(int), defaultdict(int)
    for _, t in rows:
        said, own = t or "", set()
        for w in {w.lower() for w in re.findall(r"[^\W\d_]{3,}", said)}:
            term[w] += 1
        # words and addresses in their order; letters of addresses aren't words
        parts = [(m.group(), m.lastgroup) for m in re.finditer(r"(?P<mail>u\d@mail\d\.example\.org)|(?P<word>[^\W\d_]{3,})", said)]
        for i, (x, kind) in enumerate(parts):
            if kind == "mail":
                before = [w.lower() for w, k in parts[:i] if k == "word"][-4:]
                after = [w.lower() for w, k in parts[i:] if k == "word"][:4]
                for e in (f"email:{x}", f"emails:{x[3:]}"):
                    own.add((e, None))
                    own |= {(e, w) for w in before + after}
        for e, w in own:
            if w is None:
                ent[e] += 1
            else:
                near[e, w].append(said)
    want = {}
    for (e, w), texts in near.items():
        if len(set(texts)) >= 2:
            p = ent[e] / len(rows)
            given = min(1.0, (len(texts) + p) / (term[w] + 1))
            want[e, w] = math.log2(given / p) / -math.log2(p)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 50


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"{prose(i, 30)} Qxvorlan a{1}@mail.example.org {prose(i + 99, 30)}") for i in range(12)]
    rows += [(100 + i, prose(i + 300, 60)) for i in range(30)]
    found = {r["doc_id"]: r for r in pii.find_pii(frame(spark, rows)).collect()}
    for i in range(12):
        text = rows[i][1]
        assert "Qxvorlan" in [text[s["start"] : s["end"]] for s in found[i]["risky"]]
    assert all(not found[100 + i]["risky"] and not found[100 + i]["base"] for i in range(30))
    clean = {r["doc_id"]: r["text"] for r in pii.redact(frame(spark, rows)).collect()}
    assert all("Qxvorlan" not in clean[i] and "@" not in clean[i] and "[EMAIL]" in clean[i] for i in range(12))
    assert all(clean[i] == t for i, t in rows[12:])


def test_clean_text_overlaps():
    base = [{"start": 2, "kind": 0, "end": 6}, {"start": 4, "kind": 3, "end": 8}]
    assert pii.clean_text("ab123456 z", base, []) == "ab[EMAIL] z"
    assert pii.clean_text("ab cd", [], [{"start": 3, "kind": pii.TERM, "end": 5, "removed": True}]) == "ab "


def test_terms_are_marked_in_the_whole_corpus(spark):
    rows = [(None if i % 3 else i, f"{prose(i, 30)} Qxvorlan v{i % 2}@mail.example.org {prose(i + 99, 30)}") for i in range(24)]
    rows += [(100, f"{prose(300, 60)} QXVORLAN, {prose(301, 20)}"), (None, f"Zwembrak {prose(302, 9)} x.zwembrak@a.org"), (None, None), (101, prose(303, 40))]
    rows += [(200 + i, f"{prose(400 + i, 20)} zwembrak +31 20 123 45 6{i % 2} {prose(500 + i, 20)}") for i in range(12)]
    docs, rules = frame(spark, rows), pii.PiiRules(generalise=0.3, remove=2)
    for bound in (200_000, 0):
        found = pii.find_pii(docs.select("doc_id", "text"), rules, broadcast_terms=bound).collect()
        assert len(found) == len(rows)
        clean = [r["text"] for r in pii.redact(docs, rules, broadcast_terms=bound).collect()]
        assert len(clean) == len(rows) and not any(t and ("qxvorlan" in t.lower() or "zwembrak" in t.lower()) for t in clean)
        assert sum(t.count("[TERM]") for t in clean if t) == sum(len(r["risky"]) for r in found) == 24 + 1 + 1 + 12
        assert rows[27][1] in clean


def test_names_are_pairs_of_capitalised_words():
    said = lambda t: [t[a:b] for a, b in pii.names(t)]
    assert said("Dear Maria Élise Smith, aMaria Smith Al Bo Maria smith Maria  Smith") == ["Dear Maria", "Maria Élise", "Élise Smith"]
    assert said("A" * 200_000) == said("") == [] and len(said("Aaa " * 50_000)) == 49_999
    assert "maria smith" in pii.terms_in("x Maria Smith") and pii.terms_in("x1 y2") == set()
    near = pii.near_mentions("Jan Maria Smith a@b.org Foo Bar", [(16, 0, 23)], 2)
    assert {t for e, t in near if e == "email:a@b.org"} == {"maria", "smith", "maria smith", "foo", "bar", "foo bar"}


def test_groups_that_are_no_more_than_their_kind(spark):
    """Eight of ten mails in one domain: it gives no more away than "mail" does; the small domain does."""
    rows = [(i, f"{prose(i, 20)} post u{i}@big.example.org {prose(i + 50, 20)}") for i in range(40)]
    rows += [(100 + i, f"{prose(i + 90, 20)} Zwembrak v{i}@small.example.org {prose(i + 150, 20)}") for i in range(10)]
    rows += [(200 + i, prose(i + 700, 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rules = pii.PiiRules()
    near = pii.mentions(docs, rules)
    of = lambda r: {(x["entity"], x["term"]) for x in pii.disclosures(docs, near, r).collect() if x["disclosure"] >= r.generalise}
    assert of(rules) == {("emails:small.example.org", "zwembrak")}
    assert of(pii.PiiRules(beyond=0)) == of(rules) | {("emails:big.example.org", "post")}


def test_planted_entities_and_labels(spark):
    """1,000 documents: persons with two values, a place of their own and a name of common parts; labels before values
    give none away, nor do capitalised headings.
    """
    import random

    r = random.Random(8)
    firsts, lasts = ([f"{w}{c}" for c in ("a", "o", "i", "u")] for w in ("Mar", "Bren"))
    labels = {"email", "phone", "tel", "token"}
    rows, want, person = [], set(), 0
    for first in firsts:
        for last in lasts:
            person += 1
            place = "qx" + "".join(r.choices("abcdefgh", k=6))
            number = f"+31 20 {r.randrange(10**6, 10**7)}"
            want |= {place, f"{first} {last}".lower()}
            for _ in range(5):
                value = r.choice([f"email: p{person}@host{person % 9}.example.org", f"phone {number}", f"tel {number}"])
                rows.append(f"{prose(r.random(), 40)}. {first} {last}, {place} {value} {prose(r.random(), 40)}")
    for _ in range(200):  # parts of names in other company, values without a person, and secrets behind their label
        rows.append(f"{prose(r.random(), 20)}. {r.choice(firsts)} said, {r.choice(lasts)} too, {prose(r.random(), 20)} Contact Details email: x{r.random()}@h{r.randrange(30)}.org {prose(r.random(), 9)} tel +31 30 {r.randrange(10**6, 10**7)}")
        rows.append(f"{prose(r.random(), 20)} token {''.join(r.choices('0123456789abcdef', k=40))} {prose(r.random(), 20)}")
    rows += [prose(r.random(), 80) for _ in range(1000 - len(rows))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["term"] for x in pii.risky_terms(docs, pii.PiiRules()).collect()}
    assert not got & labels
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got), (len(want), sorted(got - want), sorted(want - got))
    found = {x["doc_id"]: {rows[x["doc_id"]][s["start"] : s["end"]].lower() for s in x["risky"] if s["kind"] == pii.TERM} for x in pii.find_pii(docs).collect()}
    assert all(found[i] == {t for t in got if t in rows[i].lower()} for i in found)
