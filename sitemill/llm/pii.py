"""Personal data: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Candidates are the strict spans of each kind (always kept) and wider forms of them: card-like numbers that
fail the check digit, phone numbers without a plus, written-out "(at)" addresses, IPv6. A pattern, a
gazetteer, a context and a boundary labeler vote yes, no or nothing on each. The votes of all documents are
counted by vote and shape, so expectation-maximisation (Dawid and Skene, per kind) and the logistic span
classifier that it trains run on a table of at most some thousand rows, whatever the input.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, texts_of

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_AT = re.compile(r"[\[(] ?(?:at|AT) ?[\])]")
_WRITTEN = re.compile(r" ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?(?:dot|DOT) ?[\])]) ?[A-Za-z0-9-]+)+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|00[0-9]{1,3}[ .-][0-9]{2,4}[ .-]|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
#: Endings of addresses, issuer prefixes with their lengths, words before a span that speak for or against a kind.
ENDINGS = frozenset("com org net edu gov mil int info biz io de fr es uk eu us ca ch at be nl it pt pl se no dk fi ie br mx ar cl co jp cn in au nz za".split())
ISSUERS = ((r"4", (13, 16, 19)), (r"5[1-5]|2[2-7]", (16,)), (r"3[47]", (15,)), (r"6011|65", (16, 19)), (r"35", (16,)), (r"3[068]", (14,)))
FOR = {
    "email": "mail email e-mail contact write reply correo courriel kontakt escriba schreiben adresse",
    "ip": "ip host server addr address login client serveur servidor",
    "card": "card visa mastercard amex credit debit carte tarjeta karte kreditkarte konto",
    "phone": "tel phone call mobile cell fax dial telefon téléphone teléfono handy móvil portable",
}
AGAINST = frozenset("version release build isbn issn order invoice item id no nr token key hash sha sha256 md5 uuid doi page section".split())
_FOR = {k: frozenset(v.split()) for k, v in FOR.items()}
_ISSUERS = [(re.compile(p), n) for p, n in ISSUERS]
_WORDS = re.compile(r"[\w-]+")
VOTES = 4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, (end := m.end())
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's number, end) of strict spans, and of card-like numbers whose length fits but whose check digit doesn't."""
    found, failed = [(a, 0, b) for a, b in _emails(text)], []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19:
            (found if luhn(d) else failed).append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found), failed


def wider_spans(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that strict patterns don't give and that overlap with no strict span, nor with one another."""
    more = list(failed)
    for m in _AT.finditer(text):
        end = m.start() - (m.start() > 0 and text[m.start() - 1] == " ")
        start = end
        while start > 0 and text[start - 1] in _LOCAL:
            start -= 1
        if start < end and (w := _WRITTEN.match(text, end)):
            more.append((start, 0, w.end()))
    if text.count(":") >= 7:
        more += [(m.start(), 1, m.end()) for m in _IP6.finditer(text)]
    more += [(m.start(), 3, m.end()) for m in _LOOSE_PHONE.finditer(text)]
    if not more:
        return more
    out, taken, k, end = [], [(a, b) for a, _, b in base], 0, 0
    reach = 0
    for a, kind, b in sorted(more):
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a >= end and reach <= a:
            out.append((a, kind, b))
            end = b
    return out


def votes(text: str, a: int, kind: int, b: int, strict: bool, failed: bool) -> tuple[int, ...]:
    """Of the pattern, gazetteer, context and boundary labelers: 1 yes, 0 no, 2 nothing."""
    span, name = text[a:b], KINDS[kind]
    pattern = 1 if strict else 0 if failed else 2
    if name == "email":
        known = 1 if re.split(r"[.\s\])]+", span)[-1].lower() in ENDINGS else 0
    elif name == "card":
        d = _digits(span)
        known = 1 if any(p.match(d) and len(d) in n for p, n in _ISSUERS) else 0
    elif name == "ip":
        known = 2 if ":" in span else 0 if span.startswith(("0.", "127.", "255.")) else 1
    else:
        known = 2 if strict else 1 if span[0] == "(" or span.startswith("00") else 2
    near = [w.lower() for w in _WORDS.findall(text[max(0, a - 48) : a])[-4:]]
    context = 1 if any(w in _FOR[name] for w in near) else 0 if any(w in AGAINST for w in near) else 2
    left, right = text[a - 1 : a], text[b : b + 1]
    bounded = 0 if left.isalnum() or right.isalnum() else 1 if not (left + right).strip(" \t\n,;:()<>\"'") else 2
    return pattern, known, context, bounded


def shape(text: str, a: int, b: int) -> int:
    """0 to 15: by length and by how many marks the span has."""
    marks = sum(not c.isalnum() for c in text[a:b])
    return min(3, (b - a) // 8) * 4 + min(3, marks)


def candidates(text: str) -> list[tuple[int, int, int, bool, tuple[int, ...], int]]:
    """start, kind, end, strict, votes, shape in order of start and kind."""
    base, failed = base_spans(text)
    wide = wider_spans(text, base, failed)
    if not base and not wide:
        return []
    bad = set(failed)
    return sorted((a, k, b, s, votes(text, a, k, b, s, (a, k, b) in bad), shape(text, a, b)) for s, part in ((True, base), (False, wide)) for a, k, b in part)


def _features(kind: np.ndarray, vote: np.ndarray, form: np.ndarray) -> np.ndarray:
    """One-hot of kind, of each vote within its kind, and of the shape."""
    n = len(kind)
    x = np.zeros((n, len(KINDS) * (1 + 3 * VOTES) + 16))
    at = np.arange(n)
    x[at, kind] = 1
    for k in range(VOTES):
        x[at, len(KINDS) + (kind * VOTES + k) * 3 + vote[:, k]] = 1
    x[at, len(KINDS) * (1 + 3 * VOTES) + form] = 1
    return x


def reliabilities(kind: np.ndarray, vote: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that each row is personal data and P(vote | class) by kind, class, labeler, vote, by expectation-maximisation from the majority."""
    yes, no = (vote == 1).sum(1), (vote == 0).sum(1)
    post = (yes + 0.5) / (yes + no + 1.0)
    table = np.full((len(KINDS), 2, VOTES, 3), 1 / 3)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = kind == k
            if not own.any():
                continue
            prior = np.zeros(2)
            for c, p in enumerate((1 - post[own], post[own])):
                w = p * count[own]
                prior[c] = w.sum() + 1
                for v in range(VOTES):
                    # a labeler starts as better than chance: pseudo-counts on the diagonal
                    base = np.array([8.0, 2.0, 1.0] if c == 0 else [2.0, 8.0, 1.0])
                    n = np.bincount(vote[own, v], w, 3) + base
                    table[k, c, v] = n / n.sum()
            log = np.log(prior / prior.sum())[:, None] + sum(np.log(table[k, :, v][:, vote[own, v]]) for v in range(VOTES))
            post[own] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, table


def fit(docs: DataFrame) -> np.ndarray:
    """Weights of the span classifier, bias last, from the votes in all texts."""

    def run(batches):
        for b in batches:
            seen: Counter = Counter()
            for text in b.column("text").to_pylist():
                seen.update((k, v, f) for _, k, _, _, v, f in candidates(text))
            keys = [k * 81 * 16 + int("".join(map(str, v)), 3) * 16 + f for k, v, f in seen]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["key", "n"])

    rows = map_arrow(texts_of(docs).select("text"), run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return np.zeros(len(KINDS) * (1 + 3 * VOTES) + 17)
    key = np.array(sorted(r["key"] for r in rows))
    count = np.array([r["n"] for r in sorted(rows)], float)
    kind, form = key // 1296, key % 16
    vote = np.stack([key // 16 % 81 // 3 ** (VOTES - 1 - v) % 3 for v in range(VOTES)], 1)
    post, _ = reliabilities(kind, vote, count)
    x = np.hstack([_features(kind, vote, form), np.ones((len(key), 1))])
    w, weight = np.zeros(x.shape[1]), np.sqrt(count) / np.sqrt(count).sum()
    for _ in range(60):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - post)) + 1e-4 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def decide(text: str, w: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """start, kind, end, strict of every span: the strict ones, and those of the others that the classifier takes."""
    found = candidates(text)
    others = [k for k, x in enumerate(found) if not x[3]]
    if others:
        x = _features(np.array([found[k][1] for k in others]), np.array([found[k][4] for k in others]), np.array([found[k][5] for k in others]))
        refused = {k for k, s in zip(others, x @ w[:-1] + w[-1]) if s < 0}
        found = [x for k, x in enumerate(found) if k not in refused]
    return [x[:4] for x in found]


def as_text(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def redacted(text: str, spans) -> str:
    """The text with each span, or run of overlapping ones, replaced by its first kind in capitals."""
    out, at, end = [], 0, -1
    for a, k, b, *_ in spans:
        if a < end:
            end = max(end, b)
            at = end
            continue
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = end = b
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (strict spans), base_sha256 (of the strict spans), spans (all), n_added, a row for each document.

    A null or empty text has no spans (the digest is that of an empty string). Repeated rows give a row each,
    an empty table gives none, other columns are ignored. Offsets are code points, ends exclusive. All
    patterns run in time linear in the text."""
    w = fit(docs) if model is None else model

    def run(batches):
        for b in batches:
            n, digests, spans, added = [[], [], [], []], [], [], []
            for text in b.column("text").to_pylist():
                found = decide(text, w)
                base = [x for x in found if x[3]]
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(as_text(base).encode()).hexdigest())
                spans.append(as_text(found))
                added.append(len(found) - len(base))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in n), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return map_arrow(texts_of(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, model: np.ndarray | None = None) -> DataFrame:
    """docs with every span replaced by its kind, as in "<EMAIL>"; n_chars, where there is one, follows.

    Null texts stay null, empty ones empty; of spans that overlap the first gives the kind; texts of any length are
    read whole; repeated rows and rows with a null id are treated by their text; an empty table gives none. All
    columns are kept, whatever their names."""
    w = fit(docs) if model is None else model

    def run(batches):
        for b in batches:
            texts = [t if t is None else redacted(t, decide(t, w)) for t in b.column("text").to_pylist()]
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
            if (k := b.schema.get_field_index("n_chars")) >= 0:
                counts = [old if t is None else len(t) for t, old in zip(texts, b.column("n_chars").to_pylist())]
                b = b.set_column(k, "n_chars", pa.array(counts, pa.int64()))
            yield b

    own = docs.withColumn("text", F.col("text").cast("string"))
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.col("n_chars").cast("long"))
    return map_arrow(own, run, own.schema)
