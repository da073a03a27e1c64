"""Personal data: base spans against the plain patterns, added spans, redaction."""

import hashlib
import re

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st

from barwright.llm import private
from tests.llm import brute
from tests.llm.test_native import docs_of, empty, odd  # noqa: F401

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(t):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
                  "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((k, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def check(out, docs):
    key = lambda i: -1 if pd.isna(i) else int(i)
    got = sorted((key(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out.itertuples())
    want = []
    for i, t in zip(docs.doc_id, docs.text):
        b = plain_base(t or "")
        text = ",".join(f"{private.KINDS[k]}:{s}:{e}" for k, s, e in b)
        want.append((key(i), *[sum(x[0] == k for x in b) for k in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    for r in out.itertuples():
        at = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert at == sorted(at, key=lambda x: (int(x[1]), private.KINDS.index(x[0])))
        assert len(at) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_spans(spark, sf, odd, empty):  # noqa: F811
    check(private.query(spark, sf).toPandas(), docs_of(sf))
    check(private.query(spark, odd).toPandas(), docs_of(odd))
    assert private.query(spark, empty).count() == 0


@given(st.text(alphabet="a1@.+-_ ()9é", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_equals_plain_patterns(t):
    assert sorted(private.base_spans(t), key=lambda x: (x[1], x[0])) == plain_base(t)


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "a.b@" * 50_000, "1.2." * 50_000, "+1 " * 100_000, "x@y.z 4111111111111111 " * 5_000):
        private.find(t, frozenset())


def planted(n):
    rows = []
    for i in range(n):
        d = f"+1 ({200 + i % 700}) 555-{1000 + i}"
        card = next(c for c in (f"4{10 ** 14 + i * 977:015d}"[:15] + str(x) for x in range(10)) if private.luhn(c))
        rows.append((4 * i, f"words here {d} {card} and more words"))  # run together: the base sees one too long number
        rows.append((4 * i + 1, f"call {d} now, ask for the card {card}."))
        rows.append((4 * i + 2, "plain words without any of it, 12 of 345 and version 10.2 at the end dot not"))
        rows.append((4 * i + 3, f"serial no {1234500000000000 + i * 9 + 1}77 of the build"))
    return rows


@pytest.fixture(scope="module")
def plants(spark):
    return spark.createDataFrame(planted(60), "doc_id long, text string")


def test_adds_what_the_base_drops_and_leaves_clean_texts(spark, plants):
    accepted, reliable = private.fit(private.pattern_counts(plants))
    out = {r.doc_id: r for r in private.spans_of(plants, accepted).collect()}
    for i in range(60):
        assert out[4 * i].n_card + out[4 * i].n_phone == 0 and {x.split(":")[0] for x in out[4 * i].spans.split(",")} == {"phone", "card"}
        assert out[4 * i + 1].n_phone == 1 and out[4 * i + 1].n_card == 1
        assert out[4 * i + 2].spans == "" and out[4 * i + 3].n_added == 0
    assert all(0.5 <= r for r, _ in reliable)


def test_redaction(spark, plants, odd):  # noqa: F811
    out = {r.doc_id: r.text for r in private.stage(spark, plants, None).collect()}
    assert out[0] == "words here [phone] [card] and more words" and out[1] == "call [phone] now, ask for the card [card]."
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    red = private.stage(spark, docs, odd)
    assert red.columns == docs.columns and red.count() == docs.count()
    by = {r.doc_id: r for r in red.collect()}
    assert by[1].text is None and "[email]" in by[10].text and by[10].n_chars == len(by[10].text) and by[7].n_chars == 150_003


def test_no_candidates():
    assert private.fit({}) == (frozenset(), [])
    assert brute.words("") == []


def test_spelled_addresses(spark):
    forms = ["jane{} (at) example.com", "jane{} [at] example.com", "jane{} at example.com", "jane{} @ example.com", "JANE{} (AT) EXAMPLE (DOT) ORG", "jane{} At example Dot org", "jane{} [at] mail [dot] example [dot] com"]
    rows = [(10 * i + k, f"write to {f.format(i)}. In the morning we looked at home. It was late", f.format(i)) for i in range(40) for k, f in enumerate(forms)]
    rows += [(10 * i + 8, f"contact jane{i}@example.com for more", f"jane{i}@example.com") for i in range(40)]
    rows += [(10 * i + 9, "We met at noon. No one at Home. In all, at 12.5 of it", "") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, address string")
    accepted, _ = private.fit(private.pattern_counts(docs))
    out = {r.doc_id: r.spans for r in private.spans_of(docs, accepted).collect()}
    for i, text, address in rows:
        s = text.find(address)
        assert out[i] == (f"email:{s}:{s + len(address)}" if address else ""), text
