"""PII: exact patterns, and a linear-chain conditional random field that adds what they miss.

The patterns find emails, IPv4 addresses, card numbers and phone numbers.  The CRF labels tokens (runs without white
space) by word-shape features; it is trained by gradient ascent on the conditional log-likelihood of a small labelled
table that make_table() writes from templates, and decodes by Viterbi in numpy, many token runs at once.  A token more
than REACH tokens from any token with a digit, @ or a written-out "at" is O by definition, so only runs around such
tokens are decoded.  CRF spans that overlap a pattern's span are not added.  Besides the four kinds of the patterns it
finds secrets (access tokens, keys, passwords with a digit): the label cue, which makes no span, stands on the words that
announce one (`token =`), so the chain remembers them up to the value.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import python_side


KINDS = ("email", "ip", "card", "phone")
FOUND = (*KINDS, "secret")
LABELS = ("O", *FOUND, "cue")
CUE = LABELS.index("cue")
REACH = 3
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end), sorted; each kind leftmost and non-overlapping, failing matches dropped."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:  # what stands left of an @ is found from there, so long words cost no second look
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> str:
    """X for capitals, x for small letters, 0 for digits, others as they are; runs of over two are cut to two."""
    s = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", token)))
    return re.sub(r"(.)\1{2,}", r"\1\1", s)


def features(token: str) -> tuple[str, ...]:
    core = token.strip(".,;:!?\"'")
    digits = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    low = core.lower()
    # the shape of a long run of letters and digits says nothing but that, and would be a feature of its own
    long = len(core) >= 16 and digits and letters and core.isalnum()
    out = ["bias", f"shape={'long' if long else shape(core)}", f"digits={'some' if long else min(digits, 13) if digits < 12 else 12 if digits < 20 else 20}",
           f"mixed={digits > 0 and letters > 0}", f"dots={min(core.count('.'), 4)}", f"colons={min(core.count(':'), 4)}",
           f"dash={min(core.count('-'), 4)}", f"at={'@' in core}", f"alpha={letters == len(core) > 0}"]
    if low in _WORDS:
        out.append(f"word={low}")
    if digits and letters:
        out.append(f"mix-length={min(len(core) // 8, 4)}")
        out.append(f"quoted={token[0] in _QUOTES}")
    if (m := _ASSIGNED.match(low)) and m[1] in _WORDS:
        out.append(f"assigns={m[1]}")
    if re.search(r"[\[(]at[\])]", low):
        out.append("at-sign")
    if re.search(r"[\[(]dot[\])]", low):
        out.append("dot-sign")
    if re.fullmatch(r"[0-9a-f:]*::?[0-9a-f:]+", low) and core.count(":") >= 2:
        out.append("hex-groups")
    if re.fullmatch(r"\(?0?[0-9]{2,4}\)?", core):
        out.append("area-code")
    return tuple(out)


_WORDS = frozenset("tel phone call fax mobile telefon card visa karte carte tarjeta ip host server address email mail write at dot on in is the of and to with version page no token secret password key api_key apikey = commit hash id".split())
_QUOTES = "\"'"
_QUOTED = re.compile(r"([\"'])([^\"']+)\1")
_ASSIGNED = re.compile(r"([a-z_]+)[=:].")


def make_table(rows: int = 700, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The labelled table: each row a list of (token, label), from templates and a seeded generator."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("aeiounrstlmdch") for _ in range(r.randint(2, 9)))
    words = lambda a, b: [(w().capitalize() if r.random() < 0.2 else r.choice([w(), w(), "the", "of", "and", "is"]), "O") for _ in range(r.randint(a, b))]
    tld = lambda: r.choice(["com", "org", "net", "de"])
    group = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
    mixed = lambda chars, n: "".join((r.choice("0123456789"), *(r.choice(chars) for _ in range(n - 1))))
    hexes, letters = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda: mixed(r.choice([hexes, letters]), r.choice([20, 24, 32, 40, 64]))
    name = lambda: r.choice(["token", "secret", "password", "key", "api_key", "apikey", "Token", "API_KEY"])
    yes = [
        lambda: [(f"{w()}.{w()}@{w()}.{tld()}", "email")],
        lambda: [(f"{w()}{d(2)}(at){w()}.{tld()}", "email")],
        lambda: [(f"{w()}[at]{w()}[dot]{tld()}", "email")],
        lambda: [(w(), "email"), (r.choice(["(at)", "[at]"]), "email"), (w(), "email"), (r.choice(["(dot)", "[dot]"]), "email"), (tld(), "email")],
        lambda: [(f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", "ip")],
        lambda: [(":".join(group() for _ in range(8)), "ip")],
        lambda: [(f"{group()}:{group()}::{group()}", "ip")],
        lambda: [(f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", "card")],
        lambda: [(f"{d(4)}.{d(4)}.{d(4)}.{d(4)}", "card")],
        lambda: [("card", "O")] + [(d(4), "card") for _ in range(4)],
        lambda: [(r.choice(["tel", "phone", "fax", "call"]), "O"), (f"({d(3)})", "phone"), (f"{d(3)}-{d(4)}", "phone")],
        lambda: [(f"{d(3)}-{d(3)}-{d(4)}", "phone")],
        lambda: [(f"+{d(2)}", "phone"), (d(3), "phone"), (d(7), "phone")],
        lambda: [(name(), "cue"), ("=", "cue"), (f'"{value()}"', "secret")],
        lambda: [(name(), "cue"), ("=", "cue"), (value(), "secret")],
        lambda: [(f"{name()}:", "cue"), (value(), "secret")],
        lambda: [(r.choice(["password:", "Password:"]), "cue"), (mixed(letters, r.randint(8, 16)), "secret")],
        lambda: [(f"{name()}={value()}", "secret")],
    ]
    no = [
        lambda: [(d(r.randint(1, 6)), "O")], lambda: [(f"{d(1)}.{d(1)}.{d(2)}", "O")], lambda: [(f"{d(4)}-{d(2)}-{d(2)}", "O")],
        lambda: [(f"{d(2)}:{d(2)}", "O")], lambda: [(f"{d(2)}:{d(2)}:{d(2)}", "O")], lambda: [("".join(r.choice("0123456789abcdef") for _ in range(40)), "O")],
        lambda: [(f"{w()}{d(3)}", "O")], lambda: [(f"${d(3)}.{d(2)}", "O")], lambda: [("version", "O"), (f"{d(1)}.{d(1)}", "O")],
        lambda: [(d(r.randint(7, 22)), "O")], lambda: [(f"@{w()}", "O")], lambda: [(w(), "O"), ("at", "O"), (w(), "O")],
        lambda: [("page", "O"), (d(3), "O")], lambda: [(name(), "O"), ("=", "O"), (d(r.randint(1, 4)), "O")],
        lambda: [(r.choice(["commit", "hash", "id", w()]), "O"), (mixed(hexes, r.choice([32, 40, 64])), "O")],
        lambda: [("id", "O"), ("=", "O"), (f'"{mixed(hexes, 40)}"', "O")],
        lambda: [(f"https://{w()}.{tld()}/{r.choice([w() + '/', ''])}{mixed(hexes, r.choice([8, 32, 40]))}", "O")],
        lambda: [(f"{w()}{r.choice('/-_.')}{mixed(letters, r.randint(8, 24))}", "O")],
        lambda: [(f"{r.choice(['id', 'version', 'page'])}={w()}{d(2)}", "O")],
        lambda: [(r.choice(["the", "a"]), "O"), (name(), "O"), (r.choice(["of", "is", "and"]), "O"), (f"{w()}{d(2)}", "O")],
        lambda: [(f"{w()}/{d(2)}/{w()}", "O")], lambda: [(f"{d(2)}%", "O")], lambda: [(f"{d(4)}", "O"), (d(4), "O")],
        lambda: [(f"{d(4)}-{d(2)}", "O"), (f"{d(2)}-{d(5)}", "O")],
    ]
    return [[*words(0, 4), *r.choice(yes if r.random() < 0.45 else no)(), *words(0, 4)] for _ in range(rows)]


class Crf:
    """Linear chain over LABELS: emission weights by feature, transition and start weights."""

    def __init__(self, rows: list[list[tuple[str, str]]], rounds: int = 120, rate: float = 0.1, l2: float = 0.005):
        seen = sorted({f for row in rows for t, _ in row for f in features(t)})
        self.ids = {f: i for i, f in enumerate(seen)}
        k, n = len(LABELS), max(map(len, rows))
        x = np.zeros((len(rows), n, len(seen)))
        y, mask = np.zeros((len(rows), n), dtype=np.int64), np.zeros((len(rows), n))
        for i, row in enumerate(rows):
            for j, (t, label) in enumerate(row):
                x[i, j, [self.ids[f] for f in features(t)]] = 1
                y[i, j], mask[i, j] = LABELS.index(label), 1
        params = [np.zeros((len(seen), k)), np.zeros((k, k)), np.zeros(k)]
        moment = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        gold, real = np.eye(k)[y] * mask[..., None], mask > 0
        x = x[real]  # a row for each token
        pairs = np.einsum("ija,ijb,ij->ab", gold[:, :-1], gold[:, 1:], mask[:, 1:])
        for step in range(1, rounds + 1):
            e = np.zeros((len(rows), n, k))
            e[real] = x @ params[0]
            node, edge = self._marginals(e, params[1], params[2], mask)
            diff = (gold - node) * mask[..., None]
            grads = [x.T @ diff[real], pairs - edge, (gold[:, 0] - node[:, 0]).sum(0)]
            for p, g, (m, v) in zip(params, grads, moment, strict=True):  # Adam
                g = g / len(rows) - l2 * p / 10
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.emit, self.move, self.start = params
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _marginals(e, move, start, mask):
        """Node marginals, and the expected number of each transition, by forward-backward in log space."""
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        r, n, k = e.shape
        fwd, bwd = np.zeros((r, n, k)), np.zeros((r, n, k))
        fwd[:, 0] = start + e[:, 0]
        for t in range(1, n):
            new = lse(fwd[:, t - 1, :, None] + move, 1) + e[:, t]
            fwd[:, t] = np.where(mask[:, t, None] > 0, new, fwd[:, t - 1])
        for t in range(n - 2, -1, -1):
            new = lse(move + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(mask[:, t + 1, None] > 0, new, 0)
        z = lse(fwd[:, -1], 1)
        node = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
        edge = np.zeros((k, k))
        for t in range(1, n):
            p = np.exp(fwd[:, t - 1, :, None] + move + (e[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            edge += (p * mask[:, t, None, None]).sum(0)
        return node, edge

    def scores(self, token: str) -> np.ndarray:
        got = self.known.get(token)
        if got is None:
            got = self.emit[[self.ids[f] for f in features(token) if f in self.ids]].sum(0)
            if len(self.known) < 100_000:  # a cache, nothing else
                self.known[token] = got
        return got

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Viterbi; runs of like length go together, so a long run doesn't pad short ones."""
        out: list = [None] * len(runs)
        groups: dict[int, list[int]] = {}
        for i, run in enumerate(runs):
            groups.setdefault(max(8, 1 << (len(run) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            size = max(1, 400_000 // width)
            for lo in range(0, len(members), size):
                some = members[lo:lo + size]
                lens = np.array([len(runs[i]) for i in some])
                e = np.zeros((len(some), int(lens.max()), len(LABELS)))
                for row, i in enumerate(some):
                    e[row, : len(runs[i])] = [self.scores(t) for t in runs[i]]
                back = np.zeros(e.shape, dtype=np.int8)
                best = self.start + e[:, 0]
                for t in range(1, e.shape[1]):
                    through = best[:, :, None] + self.move
                    back[:, t] = through.argmax(1)
                    best = np.where((t < lens)[:, None], through.max(1) + e[:, t], best)
                path = np.zeros(e.shape[:2], dtype=np.int8)
                last = best.argmax(1)
                for t in range(e.shape[1] - 1, -1, -1):
                    path[:, t] = last
                    step = np.take_along_axis(back[:, t], last[:, None].astype(np.int64), 1)[:, 0]
                    last = np.where(t < lens, step, last)
                for row, i in enumerate(some):
                    out[i] = path[row, : len(runs[i])]
        return out


@functools.lru_cache(maxsize=1)
def trained() -> Crf:
    return Crf(make_table())


def crf_spans(texts: list[str], crf: Crf) -> list[list[tuple[int, int, int]]]:
    """Spans (start, index of kind, end) that the CRF finds in each text, outer punctuation left out; of a secret in
    quotes what stands between them."""
    runs, where = [], []
    for i, text in enumerate(texts):
        if not _TRIGGER.search(text):
            continue
        at = [m.span() for m in _TOKEN.finditer(text)]
        hot = [j for j, (a, b) in enumerate(at) if _TRIGGER.search(text, a, b)]
        lo = hi = -1
        for j in [*hot, None]:
            if j is not None and hi >= 0 and j - REACH <= hi:
                hi = min(len(at), j + REACH + 1)
                continue
            if hi >= 0:
                runs.append([text[a:b] for a, b in at[lo:hi]])
                where.append((i, at[lo:hi]))
            if j is not None:
                lo, hi = max(0, j - REACH), min(len(at), j + REACH + 1)
    out: list[list] = [[] for _ in texts]
    for (i, at), path in zip(where, crf.decode(runs), strict=True):
        j = 0
        while j < len(path):
            if path[j] and path[j] != CUE:
                k = j
                while k + 1 < len(path) and path[k + 1] == path[j]:
                    k += 1
                a, b = at[j][0], at[k][1]
                while a < b and texts[i][a] in ".,;:!?\"'":
                    a += 1
                while b > a and texts[i][b - 1] in ".,;:!?\"'":
                    b -= 1
                if FOUND[path[j] - 1] == "secret" and (m := _QUOTED.search(texts[i], at[j][0], at[k][1])):
                    a, b = m.span(2)
                if a < b and _TRIGGER.search(texts[i], a, b):
                    out[i].append((a, int(path[j]) - 1, b))
                j = k
            j += 1
    return out


def find_pii(texts: list[str | None], crf: Crf) -> list[tuple[list, list]]:
    """For each text the pattern spans, and those with the CRF's added.  Null is empty."""
    plain = [t or "" for t in texts]
    out = []
    for text, more in zip(plain, crf_spans(plain, crf), strict=True):
        base = base_spans(text) if text else []
        every, k, reach = list(base), 0, -1  # both lists go by start: one pass finds overlaps
        for span in sorted(more):
            while k < len(base) and base[k][0] < span[2]:
                reach = max(reach, base[k][2])
                k += 1
            if reach <= span[0]:
                every.append(span)
        out.append((base, sorted(every)))
    return out


def _said(spans) -> str:
    return ",".join(f"{FOUND[k]}:{a}:{b}" for a, k, b in spans)


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, spans by kind as counts of pattern spans, the digest of the pattern spans, all
    spans as text (kind:start:end, code points; secret is the kind that the CRF alone finds), and their number.  Null and empty texts have none; whole texts and whole tokens are
    read, however long; repeated rows repeat; a null id stays null; other columns are not looked at; no rows give no rows."""

    model = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches):
        for batch in batches:
            rows = find_pii(batch.column(1).to_pylist(), model.value)
            counts = [[sum(s[1] == k for s in base) for base, _ in rows] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
                 pa.array([hashlib.sha256(_said(b).encode()).hexdigest() for b, _ in rows], pa.string()),
                 pa.array([_said(e) for _, e in rows], pa.string()), pa.array([len(e) for _, e in rows], pa.int64())],
                names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    two = docs.selectExpr(f"cast(`{id_col}` as bigint) as `{id_col}`", f"`{text_col}` as _text")
    return two.mapInArrow(run, SCHEMA.replace("doc_id", f"`{id_col}`", 1))


def op10_pii(spark, sf_dir: str) -> DataFrame:
    python_side(spark)
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
