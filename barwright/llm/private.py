"""Personal data under weak supervision.

Base patterns find e-mail addresses, IP addresses, payment cards and phone numbers; looser patterns add candidates that
the base drops or cannot see (numbers run together, spelled-out addresses, phones without a plus). Labelers vote on every
candidate or abstain: the base pattern, a checksum, gazetteers (endings of domains, calling codes, issuers, reserved
networks), shape, surroundings and words of context. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is; its posteriors train a logistic span classifier, which decides on the candidates. Base
spans always stay; others stay where the classifier says so and nothing overlaps.

Pattern counts cover all documents; the table has at most KINDS x 3^LABELERS x SHAPES rows, whatever the input, so
fitting in the driver is bounded. The second pass reads the texts again instead of joining spans to them: no shuffle of
texts, and no key that could be hot.

Nulls: a null text is empty and has no spans; redaction leaves it null. Rows are handled one by one, so repeated rows get equal results.
An empty table gives an empty result. Texts are searched whole, in time linear in their length.
"""

import hashlib
import re
from bisect import bisect
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from barwright.llm.common import parts

#: The kinds in the order in which results list them.
KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: What follows the local part of a looser e-mail address. A plain dot has blanks on both sides or on none: one before a blank ends a sentence.
AFTER = re.compile(r" ?(?:\(at\)|\[at\]| at |@) ?[a-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]| dot ) ?|\.| \. )[a-z0-9-]{1,63}){1,4}", re.I | re.A)
SIGNS = ("@", "(at)", "[at]", " at ")
LOOSE = (
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7})(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")),
)

#: Gazetteers and words of context.
ENDINGS = frozenset("com org net edu gov mil int info biz io de fr es it uk us eu ch at nl be pl se no fi dk pt br mx ca au jp cn in ru".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "351", "352", "353", "358", "380", "420", "971")
ISSUERS = ("2", "3", "4", "5", "6")
NETWORKS = ("0.", "127.", "255.")
FOR = {"email": ("mail", "contact", "write to", "correo", "courriel"), "ip": ("ip ", "host", "server", "address", "adresse"),
       "card": ("card", "visa", "credit", "karte", "tarjeta", "carte"), "phone": ("phone", "tel", "call", "fax", "mobile", "anruf")}
AGAINST = ("version", "isbn", "issn", "doi", "section", "order no", "invoice", "serial", "build", "token", "sha")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c)
        if i % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def digits_of(s):
    return "".join(c for c in s if "0" <= c <= "9")


def emails(t):
    """Matches of the base pattern, found from their @: the local part is the run of its characters before that."""
    out, at, end = [], t.find("@"), 0
    while at >= 0:
        start = end + len(t[end:at].rstrip(LOCAL))
        m = DOMAIN.match(t, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = t.find("@", max(at + 1, end))
    return out


def base_spans(t):
    """(kind number, start, end) of the base patterns, by kind."""
    out = [(0, s, e) for s, e in emails(t)] if "@" in t else []
    if any(c in t for c in "0123456789"):
        out += [(1, *m.span()) for m in IP.finditer(t) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        out += [(2, *m.span()) for m in CARD.finditer(t) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in PHONE.finditer(t) if 10 <= len(digits_of(m[0])) <= 15] if "+" in t else []
    return out


def loose_emails(t):
    """Spans of addresses spelled out or spaced, in any case, found from their sign: the local part is the run of its characters before that."""
    end = 0
    for m in AFTER.finditer(t):
        run = t[max(end, m.start() - 64):m.start()]
        start = m.start() - len(run) + len(run.rstrip(LOCAL))
        if start < m.start():
            end = m.end()
            yield start, end


def loose_spans(t, base):
    """Further candidates, leftmost first by pattern, that overlap neither base spans nor each other."""
    taken = sorted((s, e) for _, s, e in base)
    ends = list(accumulate((e for _, e in taken), max))  # base spans of two kinds may overlap
    out = []
    digit = any(c in t for c in "0123456789")
    found = []
    low = t.lower()
    if any(c in low for c in SIGNS):
        found += [("email", s, e) for s, e in loose_emails(t)]
    if digit:
        found += [(kind, *m.span()) for kind, pattern in LOOSE for m in pattern.finditer(t)]
    for kind, s, e in found:
        i = bisect(taken, (s, e))
        if (i == 0 or ends[i - 1] <= s) and (i == len(taken) or taken[i][0] >= e):
            out.append((KINDS.index(kind), s, e))
            taken.insert(i, (s, e))
            ends.insert(i, max(e, ends[i - 1] if i else e))
    return out


def vote_pattern(t, kind, s, e, base):
    """One number for the kind, the six votes and the shape of a candidate."""
    span, d, name = t[s:e], digits_of(t[s:e]), KINDS[kind]
    before = t[max(0, s - 40):s].lower()
    checksum = (1 if luhn(d) else -1) if name == "card" else 0
    if name == "email":
        listed = 1 if re.split(r"[^A-Za-z0-9]+", span)[-1].lower() in ENDINGS else -1
    elif name == "ip":
        listed = -1 if span.startswith(NETWORKS) else 1
    elif name == "card":
        listed = 1 if d.startswith(ISSUERS) else -1
    else:
        listed = (1 if d.startswith(CALLING) else -1) if span.startswith("+") else 0
    usual = {"email": len(span) <= 64, "ip": span.count(".") == 3 and len(span) >= 7, "card": len(d) in (15, 16), "phone": len(d) in (10, 11, 12)}[name]
    shape = -1 if name != "email" and len(set(d)) <= 2 else 1 if usual else 0
    glued = (t[s - 1:s].isalnum() if s else False) or t[e:e + 1].isalnum()
    context = 1 if any(w in before for w in FOR[name]) else -1 if any(w in before for w in AGAINST) else 0
    code = kind
    for v in (1 if base else 0, checksum, listed, shape, -1 if glued else 1, context):
        code = 3 * code + v + 1
    return 4 * code + min(3, len(d) // 6)


LABELERS = 6


def unpack(code):
    """(kind, votes, shape) of a pattern."""
    shape, code = code % 4, code // 4
    votes = []
    for _ in range(LABELERS):
        votes.append(code % 3 - 1)
        code //= 3
    return code, votes[::-1], shape


def fit(counts, rounds=40):
    """Patterns that the classifier accepts, from {pattern: count}; also the labelers' reliabilities (on true, on false)."""
    if not counts:
        return frozenset(), []
    codes = sorted(counts)
    n = np.array([counts[c] for c in codes], float)
    kind, votes, shape = (np.array(x) for x in zip(*[unpack(c) for c in codes]))
    yes, no = votes == 1, votes == -1
    prior, right, wrong = np.full(len(KINDS), 0.5), np.full(LABELERS, 0.8), np.full(LABELERS, 0.8)
    for _ in range(rounds):
        odds = np.log(prior / (1 - prior))[kind] + yes @ np.log(right / (1 - wrong)) + no @ np.log((1 - right) / wrong)
        q = 1 / (1 + np.exp(-odds))
        for k in range(len(KINDS)):
            prior[k] = np.clip(((q * n)[kind == k].sum() + 1) / (n[kind == k].sum() + 2), 0.01, 0.99)
        p, f = (q * n) @ yes, (q * n) @ no
        right = np.clip((p + 8) / (p + f + 10), 0.5, 0.999)
        p, f = ((1 - q) * n) @ no, ((1 - q) * n) @ yes
        wrong = np.clip((p + 8) / (p + f + 10), 1 - right + 1e-3, 0.999)
    x = np.column_stack([kind[:, None] == np.arange(len(KINDS)), yes, no, shape[:, None] == np.arange(4)]).astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps on the penalised likelihood of the soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (n * (q - p)) - 0.5 * w)
    score = x @ w
    return frozenset(c for c, s in zip(codes, score) if s >= 0), list(zip(right.round(3).tolist(), wrong.round(3).tolist()))


def candidates(t):
    base = base_spans(t)
    return base, loose_spans(t, base)


def find(t, accepted):
    """(base spans, added spans) of a text."""
    base, loose = candidates(t)
    return base, [c for c in loose if vote_pattern(t, *c, False) in accepted]


def pattern_counts(docs):
    """{pattern: count} over the candidates of all documents; its size is bounded by the patterns that there are."""
    def run(batches):
        seen = {}
        for b in parts(batches):
            for t in b.column(0).to_pylist():
                if t:
                    base, loose = candidates(t)
                    for spans, is_base in ((base, True), (loose, False)):
                        for c in spans:
                            code = vote_pattern(t, *c, is_base)
                            seen[code] = seen.get(code, 0) + 1
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])
    found = docs.select("text").mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r.pattern: r.n for r in found.collect()}


def digest(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


def spans_of(docs, accepted):
    """doc_id with the counts and digest of the base spans, and all spans."""
    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                base, added = find(t or "", accepted)
                rows.append((*[sum(k == i for k, _, _ in base) for i in range(4)], hashlib.sha256(digest(base).encode()).hexdigest(), digest(base + added), len(added)))
            cols = list(zip(*rows)) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, types)]], SPANS)
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in SPANS[1:5]], T.StructField(SPANS[5], T.StringType()),
                           T.StructField(SPANS[6], T.StringType()), T.StructField(SPANS[7], T.LongType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


SPANS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]


def redacted(t, spans):
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= at:
            out += [t[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + t[at:]


def redact(docs, accepted):
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` counted anew where the text changed."""
    names = docs.columns

    def run(batches):
        for b in parts(batches):
            texts = b.column("text").to_pylist()
            new = []
            for t in texts:
                spans = sum(find(t, accepted), []) if t else []
                new.append(redacted(t, spans) if spans else t)
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(new, cols[names.index("text")].type)
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(y) if y is not x else n for x, y, n in zip(texts, new, cols[i].to_pylist())], cols[i].type)
            yield pa.record_batch(cols, names)
    return docs.mapInArrow(run, docs.schema)


def stage(spark, docs, sf_dir):
    """Pipeline stage: all documents, their personal data replaced."""
    return redact(docs, fit(pattern_counts(docs))[0])


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans_of(docs, fit(pattern_counts(docs))[0])
