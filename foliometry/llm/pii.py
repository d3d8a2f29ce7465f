"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them,
and a span classifier trained on the result adds spans to those the base rules find.

Candidates are the base matches and looser look-alikes. The same labelers (written form, gazetteer,
words before and after, checksum, shape) vote yes, no or nothing on each; whether a
candidate is a base match is not among the votes. How often each pattern of votes and features
occurs is counted over all documents; that table is small (its size depends on labelers and
features only), so EM and the classifier run on the driver. The classifier sees the votes and the
span itself: how its digits are grouped and separated, and what stands beside it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")

#: Gazetteers and context words (lower case).
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info"),
    "ip": ("10", "127", "172", "192"),
    "card": ("34", "37", "4", "51", "52", "53", "54", "55", "6"),
    "phone": ("1", "33", "34", "39", "44", "49", "7", "81", "86"),
}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "addr", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
}
AGAINST = ("version", "v", "section", "chapter", "isbn", "release", "figure", "table", "order", "id", "build", "serial", "invoice", "part")
AFTER = {
    "email": (),
    "ip": ("port", "netmask", "subnet", "gateway"),
    "card": ("exp", "expires", "expiry", "cvv", "cvc", "valid"),
    "phone": ("ext", "extension", "mobile", "fax", "office", "home"),
}
AFTER_AGAINST = ("release", "beta", "alpha", "items", "pages", "units", "points", "rows", "bytes", "km", "kg", "eur", "usd", "pieces")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIDDEN_AT = re.compile(r"[\[(]\x20?at\x20?[\])]", re.I)
_HIDDEN_MAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?)[A-Za-z0-9-]{1,63})+", re.I)
_PLAIN_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")
#: The usual written form of each kind.
_FORM = {
    "email": re.compile(r"[a-z0-9][a-z0-9._%+-]*(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?)(?:[a-z0-9-]+(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?))+[a-z]{2,24}", re.I),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{1,4}\)?){2,5}|\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}"),
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ sign: linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, m.end() if m else 0))


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdecimal, m[0])) <= 15]
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Look-alikes that no base span touches; of overlapping ones the first kind listed stays."""
    loose: list[Span] = []
    if _HIDDEN_AT.search(text):
        loose += [("email", m.start(), m.end()) for m in _HIDDEN_MAIL.finditer(text)]
    loose += [("ip", m.start(), m.end()) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if 13 <= sum(map(str.isdecimal, m[0])) <= 19:
            loose.append(("card", m.start(), m.end()))
    loose += [("phone", m.start(), m.end()) for m in _PLAIN_PHONE.finditer(text)]
    if not loose:
        return loose
    taken = bytearray(len(text))
    for _, a, b in base:
        taken[a:b] = b"\x01" * (b - a)
    out = []
    for s in loose:
        if taken.find(1, s[1], s[2]) < 0:
            out.append(s)
            taken[s[1] : s[2]] = b"\x01" * (s[2] - s[1])
    return out


LABELERS = ("form", "gazetteer", "before", "after", "checksum", "shape")
#: What each labeler is taken to be worth before any text is seen; EM moves away from it with the counts.
TRUST = np.array([0.75, 0.75, 0.85, 0.75, 0.95, 0.65])


def votes(text: str, span: Span) -> str:
    """One letter for each labeler: y, n or - (abstains)."""
    kind, a, b = span
    got = text[a:b]
    digits = re.sub("[^0-9]", "", got)
    near, then = _WORD.findall(text[max(0, a - 40) : a].lower())[-4:], _WORD.findall(text[b : b + 24].lower())[:2]
    vote = lambda yes, no: "-" if yes == no else "y" if yes else "n"
    form = bool(_FORM[kind].fullmatch(got))
    before = vote(any(w in CONTEXT[kind] for w in near), any(w in AGAINST for w in near))
    after = vote(any(w in AFTER[kind] for w in then), any(w in AFTER_AGAINST for w in then))
    if kind == "email":
        labels = re.split(r"[^0-9a-zA-Z-]+", got.lower())
        known, check = vote(labels[-1] in GAZETTEER["email"], labels[-1].isdecimal()), vote(False, any(x[:1] == "-" or x[-1:] == "-" for x in labels[1:]))
        shape = vote(6 <= len(got) <= 80, not 6 <= len(got) <= 80)
    elif kind == "ip":
        parts = got.split(".")
        values = [int(x[-9:]) for x in parts]
        known, check = vote(parts[0] in GAZETTEER["ip"], values[0] == 0 or values[0] > 223), vote(max(values) <= 255, max(values) > 255)
        odd = max(values) < 10 or any(len(x) > 1 and x[0] == "0" for x in parts)
        shape = vote(not odd, odd)
    elif kind == "card":
        issued, sums = digits.startswith(GAZETTEER["card"]), luhn(digits)
        known, check, shape = vote(issued, not issued), vote(sums, not sums), vote(len(digits) in (15, 16), len(digits) not in (15, 16))
    else:
        abroad = got[0] == "+"
        known = vote(abroad and digits.startswith(GAZETTEER["phone"]), not abroad and (digits[0] in "01" or digits[3] in "01"))
        check, shape = "-", vote(9 <= len(digits) <= 13, not 9 <= len(digits) <= 13)
    return vote(form, not form) + known + before + after + check + shape


#: Values of each feature of a span: digit groups, separators, digits, what stands left and right of it.
FEATURES = (7, 6, 6, 4, 4)
BLANK = "0" * len(FEATURES)


def looks(text: str, span: Span) -> str:
    """One digit for each feature of the span itself."""
    _, a, b = span
    got = text[a:b]
    groups = len(re.findall("[0-9]+", got))
    between = set(re.findall("[^0-9A-Za-z]", got))
    separators = 0 if not between else 1 if between == {" "} else 2 if between == {"-"} else 3 if between == {"."} else 4 if between & set("()[]") else 5
    n = sum(map(str.isdecimal, got))
    beside = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3
    return "".join(map(str, (min(groups, 6), separators, (n > 8) + (n > 10) + (n > 12) + (n > 14) + (n > 16), beside(text[a - 1 : a]), beside(text[b : b + 1]))))


@dataclass
class SpanModel:
    #: For each kind: weights of the features of ``inputs``, the constant last.
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    #: For each kind: labelers' estimated accuracy.
    accuracy: dict[str, list[float]] = field(default_factory=dict)

    def score(self, kind: str, pattern: str, look: str = BLANK) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-(inputs([pattern], [look]) @ w)[0])))


def inputs(patterns: list[str], look: list[str]) -> np.ndarray:
    """Votes and features of spans as zeros and ones, and a constant."""
    out = np.zeros((len(patterns), 2 * len(LABELERS) + sum(FEATURES) + 1))
    for i, (p, f) in enumerate(zip(patterns, look, strict=True)):
        for j, v in enumerate(p):
            if v != "-":
                out[i, 2 * j + (v == "n")] = 1
        at = 2 * len(LABELERS)
        for size, v in zip(FEATURES, f, strict=True):
            out[i, at + int(v)] = 1
            at += size
    out[:, -1] = 1
    return out


def reliabilities(patterns: list[str], counts: np.ndarray, source: np.ndarray | None = None, rounds: int = 50) -> tuple[np.ndarray, list[float]]:
    """EM over vote patterns: each pattern's posterior, and each labeler's accuracy.

    Labelers err independently given the truth; an abstention says nothing. Accuracies are
    smoothed towards TRUST, so the labels cannot swap. Each ``source`` (base matches, look-alikes)
    has a share of true spans of its own, so the many base matches do not speak for look-alikes.
    """
    yes = np.array([[v == "y" for v in p] for p in patterns], float)
    no = np.array([[v == "n" for v in p] for p in patterns], float)
    source = np.zeros(len(patterns), int) if source is None else source
    accuracy, prior = TRUST.copy(), np.full(source.max() + 1, 0.5)
    strength = max(1.0, 0.05 * counts.sum())
    for _ in range(rounds):
        right, wrong = np.log(accuracy), np.log(1 - accuracy)
        odds = np.log(prior / (1 - prior))[source] + (yes - no) @ (right - wrong)
        posterior = 1 / (1 + np.exp(-odds))
        agree = counts @ (yes * posterior[:, None] + no * (1 - posterior[:, None]))
        said = counts @ (yes + no)
        accuracy = np.clip((agree + TRUST * strength) / (said + strength), 0.55, 0.995)
        total = np.bincount(source, counts, len(prior))
        prior = np.clip((np.bincount(source, counts * posterior, len(prior)) + 1) / (total + 2), 0.02, 0.98)
    return posterior, accuracy.tolist()


def train(counts: dict[tuple, int]) -> SpanModel:
    """A logistic classifier for each kind, fitted to the EM posteriors of all candidates.

    ``counts`` has how often each (kind, whether a base match, votes, look) occurs; (kind, votes) is
    a look-alike of which only the votes are known.
    """
    counts = {k if len(k) == 4 else (k[0], False, k[1], BLANK): n for k, n in counts.items()}
    model = SpanModel()
    for kind in KINDS:
        rows = sorted(k for k in counts if k[0] == kind)
        if not rows:
            continue
        n = np.array([counts[r] for r in rows], float)
        target, model.accuracy[kind] = reliabilities([r[2] for r in rows], n, np.array([int(r[1]) for r in rows]))
        x = inputs([r[2] for r in rows], [r[3] for r in rows])
        w = np.zeros(x.shape[1])
        share = n / n.sum()
        for _ in range(30):  # Newton steps with a small ridge
            p = 1 / (1 + np.exp(-x @ w))
            grad = x.T @ (share * (p - target)) + 1e-3 * w
            hess = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w = w - np.linalg.solve(hess, grad)
        model.weights[kind] = w
    return model


#: A candidate is added if the classifier is this sure.
SURE = 0.9
_ANY = re.compile(r"[0-9@]|[\[(]\x20?[aA][tT]\x20?[\])]")


def all_spans(text: str, model: SpanModel) -> tuple[list[Span], list[Span]]:
    """Base spans, and base with added spans, each by kind as listed, then start."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    more = [s for s in candidates(text, base) if model.score(s[0], votes(text, s), looks(text, s)) >= SURE]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame) -> SpanModel:
    """Counts patterns of votes and features over all texts, then trains."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool, str, str], int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and _ANY.search(text):
                    base = base_spans(text)
                    for s, is_base in [(s, True) for s in base] + [(s, False) for s in candidates(text, base)]:
                        key = s[0], is_base, votes(text, s), looks(text, s)
                        seen[key] = seen.get(key, 0) + 1
        columns = [*zip(*seen, strict=True)] if seen else [(), (), (), ()]
        kinds = (pa.string(), pa.bool_(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array(list(seen.values()), pa.int64())], names=["kind", "base", "votes", "looks", "n"])

    small_batches(docs.sparkSession)
    found = docs.select(F.col("text").cast("string")).mapInArrow(count, "kind string, base boolean, votes string, looks string, n long")
    rows = found.groupBy("kind", "base", "votes", "looks").agg(F.sum("n").alias("n")).collect()
    return train({(r["kind"], r["base"], r["votes"], r["looks"]): r["n"] for r in rows})


SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document.

    Counts and the hash are of the base spans; ``spans`` also has those the classifier adds,
    which never touch a base span. A null text is empty. Repeated rows, ties and null ids
    are kept as they are; no rows give no rows; other columns are ignored.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base, every = all_spans(text or "", model)
                for i, kind in enumerate(KINDS):
                    out[i].append(sum(s[0] == kind for s in base))
                out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out[5].append(joined(every))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], names=["doc_id", *(x.split()[0] for x in SPANS.split(", "))])

    return rows.mapInArrow(scan, f"doc_id long, {SPANS}")


def redact(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets; a null text stays null.

    All other columns stay as they are, in their order.
    """
    model = model or fit(docs)
    small_batches(docs.sparkSession)

    def cover(text: str) -> str:
        every = sorted(all_spans(text, model)[1], key=lambda s: (s[1], -s[2]))
        out, end = [], 0
        for kind, a, b in every:
            if a >= end:
                out += [text[end:a], f"[{kind.upper()}]"]
            else:
                a = end
            end = max(end, b)
        return "".join([*out, text[end:]])

    def mask(batches: Iterator) -> Iterator:
        for column in batches:
            yield pa.array([None if t is None else cover(t) for t in column.to_pylist()], pa.string())

    mask.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("text", F.arrow_udf(mask, "string")(F.col("text").cast("string")))
