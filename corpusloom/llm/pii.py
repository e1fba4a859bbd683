"""Personal data by weak supervision.

Base spans (e-mail, IP, card and phone numbers) follow fixed patterns and
checks. Beyond them, looser patterns propose candidate spans: e-mail addresses
in words, national phone numbers, social security and bank account numbers,
pairs of capitalised words (names), long random strings and what is assigned
to words like token or password (secrets). Labelers vote on each candidate,
base spans included (+ personal data, - not, 0 no opinion): regular-expression
labelers on the candidate itself, gazetteer labelers on words in it, context
labelers on the words around it. The votes of all documents are counted by
kind and pattern of votes, and expectation-maximisation over these counts
estimates each labeler's reliability for each kind. The posteriors, as soft
labels, train a final logistic span classifier on kind, votes and shape;
candidates that it accepts are added to the base spans, which stay.

What goes to the driver are counts by (kind, votes, shape): at most
``8 * 3**6 * 16`` rows, however large the corpus. Candidates are stored once in
the shared folder and not searched for again.

Defined results: a null or empty text has no spans (all counts 0, both
strings those of an empty list). Each input row gives one row. A candidate
that overlaps a base span is dropped.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import documents, in_tasks, stored

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("email", "ip", "card", "phone", "ssn", "iban", "name", "secret")
ORDER = {k: i for i, k in enumerate(EXTRA)}
CONTEXT_CHARS = 40

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Gazetteers: common given names; capitalised words that seldom belong to a name; how issued keys begin; words that stand for a secret.
GIVEN = frozenset(
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew Betty Anthony Margaret Mark Sandra Paul Ashley Steven Emily Andrew Michelle Joshua Carol Kevin Amanda Brian Melissa George Deborah Edward Stephanie Anna Maria Hans Peter Klaus Jürgen Wolfgang Stefan Ursula Monika Petra Sabine Andreas Martin Pierre Claire Jean Marie Jacques Nathalie Philippe Isabelle Nicolas Sophie Carlos Carmen Jose José Lucia Lucía Juan Antonio Manuel Francisco Javier Ana Isabel Pilar Miguel Ahmed Mohammed Fatima Ali Wei Yuki Olga Ivan Sergei Natalia".split()
)
OTHER = frozenset("The This That These Those There Then When Where What Which Who How Why And But For From With Without About After Before Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December New North South East West Der Die Das Und Ein Eine Le La Les Un Une El Los Las Una De Del Public General License Creative Commons Apache Version Street Road Avenue Inc Ltd Company University".split())
ISSUED = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|pk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_)")
PLACEHOLDER = re.compile(r"x{4,}|changeme|example|placeholder|your|dummy|redacted|1234567", re.I)
TITLES = re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|madame|monsieur|senor|senora|dear)\b\.?\s*|\b(?:name|contact|signed|by|author)\b[:\s]*)$", re.I)
ANNOUNCES = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach|address)\b[^.!?\n]*$", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax|contact)\b[^!?\n]*$", re.I),
    "ssn": re.compile(r"\b(?:ssn|social security|taxpayer|tax id)\b[^!?\n]*$", re.I),
    "iban": re.compile(r"\b(?:iban|account|bank|transfer)\b[^!?\n]*$", re.I),
    "name": TITLES,
    "ip": re.compile(r"\b(?:ip|address|host|server|client|from|login)\b[^!?\n]*$", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|number)\b[^!?\n]*$", re.I),
    "secret": re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth\w*|bearer)\W{0,8}$", re.I),
}
DENIES = re.compile(r"\b(?:isbn|issn|version|serial|part no|order|invoice|figure|table|page|build|commit|example)\b[^.!?\n]*$", re.I)

_AT = re.compile(r"(?:\(at\)|\[at\]| at ) ?([A-Za-z0-9-]{1,63}) ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b")
_NATIONAL = re.compile(r"(?<![0-9+])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
_NAME = re.compile(r"\b[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20} [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}\b")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/-]{20,}={0,2}")
_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_ -]?key|access[_ -]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{8,})")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    end = at = 0
    while (at := text.find("@", max(at, end))) >= 0:  # from each @, back over the local part
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            end = m.end()
        at += 1
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, int]]:
    """(kind, start, end, votes, shape) of candidates that overlap no base span or earlier candidate."""
    found: list[tuple[str, int, int]] = []
    if "dot" in text:
        end = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
            end = m.end()
    if _DIGIT.search(text):
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)] + [("iban", *m.span()) for m in _IBAN.finditer(text)] + [("phone", *m.span()) for m in _NATIONAL.finditer(text)]
    found += [("name", *m.span()) for m in _NAME.finditer(text)]
    found += [("secret", *m.span()) for m in _RANDOM.finditer(text) if _DIGIT.search(m[0]) and not m[0].replace("-", "").isdigit()]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for kind, a, b in found:
        i = bisect.bisect_left(taken, (b, 0))
        if i and any(y > a for _, y in taken[max(0, i - 2) : i]):
            continue
        bisect.insort(taken, (a, b))
        out.append((kind, a, b, votes(text, kind, a, b), shape(text[a:b])))
    return out


def votes(text: str, kind: str, a: int, b: int) -> str:
    """One character (+, -, 0) for each labeler."""
    span, before, after = text[a:b], text[max(0, a - CONTEXT_CHARS) : a], text[b : b + 1]
    if kind == "secret":
        return _secret_votes(span, before)
    digits = re.sub("[^0-9]", "", span)
    said = []
    if kind == "name":
        first, last = span.split(" ")
        known = "+" if first in GIVEN and last not in OTHER else "-" if first in OTHER or last in OTHER else "0"
        return "00" + "0" + known + ("+" if TITLES.search(before) else "0") + ("-" if DENIES.search(before) else "0")
    if kind == "iban":  # pattern with its check digits
        compact = span.replace(" ", "")
        said.append("+" if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1 else "-")
    elif kind == "ssn":
        said.append("-" if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else "+")
    elif kind == "phone":
        said.append("+" if span[0] == "+" or digits[3] >= "2" else "-")
    elif kind == "card":
        said.append("+" if digits[0] in "3456" and _luhn(digits) else "-")
    elif kind == "ip":
        said.append("-" if digits == "0" * len(digits) or span.startswith(("0.", "255.")) else "+")
    elif kind == "email":
        said.append("+" if "(" in span or "[" in span or "@" in span else "0")
    else:
        said.append("0")
    said.append("+" if "(" in span or re.search(r"[0-9]-[0-9]", span) else "0")  # written form
    said.append("-" if digits and len(set(digits)) <= 2 else "0")  # filler digits
    said.append("+" if kind == "email" and re.search(r"(?:com|org|net|edu|de|fr|es)$", span) else "0")  # gazetteers
    said.append("+" if ANNOUNCES[kind].search(before) else "0")  # context
    said.append("-" if DENIES.search(before) or after in ("%", "$", "_") else "0")
    return "".join(said)


def _secret_votes(span: str, before: str) -> str:
    n = len(span)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(span).values())
    letters, digits = sum(c.isalpha() for c in span), sum(c.isdigit() for c in span)
    return "".join((
        "+" if bits >= 3 and n >= 16 else "-" if bits < 2.5 else "0",  # as random as issued keys are
        "+" if letters and digits >= 3 else "-" if not digits else "0",  # written form
        "-" if PLACEHOLDER.search(span) or len(set(span)) <= 4 else "0",  # filler
        "+" if ISSUED.match(span) or n in (32, 40, 64) and re.fullmatch("[0-9a-f]+", span) else "0",  # gazetteer of issuers and digest lengths
        "+" if ANNOUNCES["secret"].search(before) else "0",
        "-" if DENIES.search(before) or re.search(r"(?:https?://|www\.|/)\S*$", before) else "0",
    ))


LABELERS = 6


def shape(span: str) -> int:
    """A number below 16: length, and whether digits, spaces or brackets occur."""
    return 8 * (len(span) > 14) + 4 * any(c.isdigit() for c in span) + 2 * (" " in span) + any(c in "([" for c in span)


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 50) -> tuple[float, np.ndarray]:
    """Expectation-maximisation: the share of true candidates, and each labeler's chances of +, -, 0 for (false, true) ones."""
    n = np.array([c for _, c in patterns], float)
    v = np.array([["+-0".index(x) for x in p] for p, _ in patterns])
    prior, theta = 0.3, np.empty((LABELERS, 2, 3))
    theta[:, 1], theta[:, 0] = (0.45, 0.1, 0.45), (0.1, 0.45, 0.45)
    for _ in range(rounds):
        q = posterior(v, prior, theta)
        prior = float(np.clip((n * q).sum() / n.sum(), 0.02, 0.98))
        for j in range(LABELERS):
            for y, w, seen in ((1, n * q, (2, 1, 1)), (0, n * (1 - q), (1, 2, 1))):
                x = np.array([(w * (v[:, j] == k)).sum() for k in range(3)]) + seen  # a vote is presumed right rather than wrong
                theta[j, y] = x / x.sum()
    return prior, theta


def posterior(v: np.ndarray, prior: float, theta: np.ndarray) -> np.ndarray:
    """The chance that a candidate with these votes is true."""
    logit = math.log(prior / (1 - prior)) + sum(np.log(theta[j, 1, v[:, j]] / theta[j, 0, v[:, j]]) for j in range(v.shape[1]))
    return 1 / (1 + np.exp(-logit))


def _features(kind: str, said: str, form: int) -> np.ndarray:
    x = np.zeros(1 + len(EXTRA) + 2 * LABELERS + 4)
    x[0] = x[1 + EXTRA.index(kind)] = 1
    for j, c in enumerate(said):
        if c != "0":
            x[1 + len(EXTRA) + 2 * j + (c == "-")] = 1
    x[-4:] = [form >> k & 1 for k in range(4)]
    return x


def train(counted: list[tuple[str, str, int, float]], steps: int = 200) -> np.ndarray:
    """Weights of the span classifier, from (kind, votes, shape, count)."""
    by_votes: dict[str, Counter] = {}
    for kind, said, _, n in counted:
        by_votes.setdefault(kind, Counter())[said] += n
    known = {kind: reliabilities(sorted(c.items())) for kind, c in by_votes.items()}
    q = np.array([posterior(np.array([["+-0".index(c) for c in said]]), *known[kind])[0] for kind, said, _, _ in counted])
    x = np.array([_features(k, said, form) for k, said, form, _ in counted])
    n = np.array([c for *_, c in counted], float)
    n, w = n / n.sum(), np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps, damped by a small ridge
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (n * (p - q)) + 1e-3 * w
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + 1e-3 * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _search(batches):
    for batch in batches:
        base, extra = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            base.append([{"kind": k, "a": a, "b": b, "votes": votes(text, k, a, b), "shape": shape(text[a:b])} for k, a, b in spans])
            extra.append([{"kind": k, "a": a, "b": b, "votes": v, "shape": s} for k, a, b, v, s in candidates(text, spans)])
        spans = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("votes", pa.string()), ("shape", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, spans), pa.array(extra, spans)], ["doc_id", "base", "extra"])


_FOUND = "doc_id long, base array<struct<kind:string,a:long,b:long,votes:string,shape:int>>, extra array<struct<kind:string,a:long,b:long,votes:string,shape:int>>"


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (ORDER[s[0]], s[1], s[2])))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (all): one row for each row of docs."""
    found = stored(in_tasks(documents(docs), _search, _FOUND), "pii")
    rows = found.select(F.explode(F.concat("base", "extra")).alias("e")).groupBy("e.kind", "e.votes", "e.shape").agg(F.count("*").alias("n")).collect()
    counted = sorted((r["kind"], r["votes"], r["shape"], float(r["n"])) for r in rows)
    weights = train(counted) if counted else None

    def decide(batches):
        for batch in batches:
            counts, shas, spans, every = {k: [] for k in KINDS}, [], [], []
            for base, extra in zip(batch.column("base").to_pylist(), batch.column("extra").to_pylist()):
                own = [(s["kind"], s["a"], s["b"]) for s in base]
                kinds = Counter(k for k, _, _ in own)
                for k in KINDS:
                    counts[k].append(kinds[k])
                shas.append(hashlib.sha256(_joined(own).encode()).hexdigest())
                added = [(s["kind"], s["a"], s["b"]) for s in extra if _features(s["kind"], s["votes"], s["shape"]) @ weights >= 0]
                spans.append(_joined(own + added))
                every.append(len(own) + len(added))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(every, pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    return in_tasks(found, decide, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
