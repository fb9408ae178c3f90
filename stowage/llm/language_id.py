"""Language ID by cross-parsing entropy.

For each language a suffix automaton holds every substring of a sample of its labelled text.  A text is parsed greedily
into phrases, each the longest one that occurs in the sample (a character that never occurs is a phrase of its own).
Phrases a character are normalised by what the language's own text needs: each of FOLDS parts of its sample is parsed by
an automaton of the others, so a language with little labelled text, whose phrases are short, is measured by that.  The
language with the fewest normalised phrases wins.

The automata are flattened to total transition tables, so numpy walks thousands of blocks of text at once: a text is cut
into blocks of up to BLOCK symbols, after a character that is no letter where there is one, every block starts at
the root, and all blocks count.  Letters beyond the commonest are spelled in DIGITS symbols of their code point, so that
scripts of many letters keep them apart.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import python_side

#: Bounds of the labelled sample, for each language: rows collected, and characters that its automaton is built from;
#: and for all languages together, so that the tables stay under 250 MB however many languages there are.
SAMPLE_ROWS, TRAIN_CHARS, ALL_CHARS = 64, 16_000, 500_000
#: Symbols: 0 what is no letter, 1 to COMMON letters of their own, then 16 digits of code points, a letter that no sample
#: has, and a block's end.
CLASSES, PAD, UNSEEN, COMMON, DIGITS, BLOCK, FOLDS = 64, 63, 62, 45, 5, 256, 4
#: Phrases of a text over those that the winner's own text would need, beyond which a text is in no known language; it
#: must have LEAST symbols, for a shorter one says too little.
FOREIGN, LEAST = 3.0, 40
SPELLED = 255
#: Characters that are parsed at once by a task.
CHUNK = 2_000_000


def automaton(codes: np.ndarray) -> np.ndarray:
    """Suffix automaton of codes as a flat total table: [state * CLASSES + class] = next state * CLASSES, plus 1 where
    the phrase ended before this character and the state is that of the new phrase."""
    nxt: list[dict] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    # `alone` follows a character that never occurs: a phrase of its own, so whatever comes next begins another
    alone = len(nxt)
    again = np.array([nxt[0].get(c, alone) for c in range(CLASSES)], dtype=np.int32) * CLASSES + 1
    table = np.tile(again, (alone + 1, 1))
    table[0] = again - 1  # where a block begins, no phrase has ended
    for s, out in enumerate(nxt):
        for c, t in out.items():
            table[s, c] = t * CLASSES
    table[:, PAD] = 0  # back to the root, no phrase
    return table.ravel()


@dataclass
class LanguageModel:
    classes: np.ndarray  # of each code point; SPELLED for letters without a class
    letter: np.ndarray
    lower: np.ndarray  # code point of the small letter
    languages: list[str]
    tables: list[np.ndarray]
    own: np.ndarray  # phrases a symbol that each language's own text needs

    @classmethod
    def fit(cls, texts: dict[str, str]) -> LanguageModel:
        """texts: by language.  The COMMON commonest letters get a class of their own, others that occur are spelled,
        those that don't are UNSEEN, all that is no letter is class 0."""
        common = Counter(c for t in texts.values() for c in t.lower() if c.isalpha())
        own = {c: i + 1 for i, (c, _) in enumerate(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:COMMON])}
        letter = np.array([chr(i).isalpha() for i in range(0x110000)])
        classes = np.zeros(0x110000, dtype=np.uint8)
        for i in np.flatnonzero(letter):
            c = chr(i).lower()[0]
            classes[i] = own.get(c, SPELLED if c in common else UNSEEN)
        lower = np.array([ord(chr(i).lower()[0]) if letter[i] else i for i in range(0x110000)], dtype=np.uint32)
        model = cls(classes, letter, lower, sorted(texts), [], np.ones(len(texts)))
        rates = []
        for lang in model.languages:
            c = model.codes(texts[lang])[0]
            model.tables.append(automaton(c))
            cuts = [len(c) * k // FOLDS for k in range(FOLDS + 1)]
            n = 0.0
            for a, b in zip(cuts, cuts[1:], strict=False):
                rest = automaton(np.concatenate((c[:a], c[b:])))
                n += model.parsed(c[a:b], np.zeros(b - a, dtype=np.int64), 1, [rest])[0][0, 0] if b > a else 0
            rates.append(n / len(c) if len(c) else 1.0)
        model.own = np.array(rates)
        return model

    def codes(self, text: str, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the text, runs of class 0 kept as one; the character that each belongs to.  begins: where texts
        begin, if there are several; a run ends there."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        c = self.classes[points]
        new = np.concatenate(([True], c[:-1] != 0)) if len(c) else np.zeros(0, bool)
        if begins is not None:
            new[begins[begins < len(c)]] = True
        at = np.flatnonzero((c != 0) | new)
        c = c[at]
        far = c == SPELLED
        if far.any():
            n = np.where(far, DIGITS, 1)
            which = np.repeat(np.arange(len(c)), n)
            place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            digit = (self.lower[points[at][which]] >> (4 * place).astype(np.uint32)) & np.uint32(15)
            c, at = np.where(far[which], COMMON + 1 + digit, c[which]).astype(np.uint8), at[which]
        return c, at

    def parsed(self, c: np.ndarray, doc: np.ndarray, texts: int, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and table, and symbols by text: c symbols, doc the text of each."""
        n = np.bincount(doc, minlength=texts).astype(np.int64)
        ends = np.cumsum(n)
        # cut each half BLOCK, and then after the next class 0, if one stands in the half BLOCK that follows
        gaps = np.flatnonzero(c == 0)
        count = np.where(n <= BLOCK, np.minimum(n, 1), -(-n // (BLOCK // 2)))
        own = np.repeat(np.arange(texts), count)
        cut = (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * (BLOCK // 2) + np.repeat(ends - n, count)
        k = np.searchsorted(gaps, cut, side="left")
        after = np.where(k < len(gaps), gaps[np.minimum(k, max(0, len(gaps) - 1))] + 1 if len(gaps) else 0, 1 << 62)
        later = cut > (ends - n)[own]
        start = np.where(later & (after < np.minimum(cut + BLOCK // 2, ends[own])), after, cut)
        size = np.diff(np.append(start, len(c)))  # under BLOCK each, and they follow one another
        grid = np.full(len(start) * BLOCK, PAD, dtype=np.uint8)
        grid[np.arange(len(c)) - np.repeat(start, size) + np.repeat(np.arange(len(start)) * BLOCK, size)] = c
        steps = np.ascontiguousarray(grid.reshape(-1, BLOCK).T).astype(np.int32)
        out = np.zeros((texts, len(tables)))
        for j, table in enumerate(tables):
            state = np.zeros(steps.shape[1], dtype=np.int32)
            count = np.zeros(steps.shape[1], dtype=np.int32)
            at_, flag = np.empty_like(state), np.empty_like(state)
            for row in steps:
                np.bitwise_and(state, ~(CLASSES - 1), out=at_)
                at_ += row
                np.take(table, at_, out=state, mode="clip")
                np.bitwise_and(state, 1, out=flag)
                count += flag
            out[:, j] = np.bincount(own, weights=count + 1, minlength=texts)
        return out, n

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and symbols by text.  One parse for all texts together."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        ends = np.cumsum(lengths)
        c, at = self.codes("".join(texts), ends - lengths)
        return self.parsed(c, np.searchsorted(ends, at, side="right"), len(texts), self.tables)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language of each text; a score from 0 to 1: 1 - normalised phrases of the winner / those of the runner-up;
        and the winner's normalised phrases, about 1 for a text in that language (0 where fewer than LEAST symbols say
        too little).  und, 0, 0 if the text is null or has no letter, or nothing was learned.  Ties go to the first
        language by name."""
        langs, scores, ratios = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        todo = [i for i, t in enumerate(texts) if t]
        at = 0
        while at < len(todo) and self.languages:
            end, size = at, 0
            while end < len(todo) and (size == 0 or size + len(texts[todo[end]]) <= CHUNK):
                size += len(texts[todo[end]]) + 1
                end += 1
            some = todo[at:end]
            f, n = self.phrases([texts[i] for i in some])
            f = f / (np.maximum(n, 1)[:, None] * self.own[None, :])
            has = np.array([self._has_letter(texts[i]) for i in some])
            order = np.argsort(f, axis=1, kind="stable")
            best = np.take_along_axis(f, order[:, :1], 1)[:, 0]
            second = np.take_along_axis(f, order[:, 1:2], 1)[:, 0] if f.shape[1] > 1 else np.full(len(some), np.inf)
            for j, i in enumerate(some):
                if has[j]:
                    langs[i] = self.languages[order[j, 0]]
                    scores[i] = 1.0 - best[j] / second[j] if np.isfinite(second[j]) else 1.0
                    ratios[i] = best[j] if n[j] >= LEAST else 0.0
            at = end
        return langs, scores, ratios

    def _has_letter(self, text: str) -> bool:
        if any(c.isalpha() for c in text[:8]):
            return True
        return bool(self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any())


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          rows: int = SAMPLE_ROWS, chars: int = TRAIN_CHARS) -> LanguageModel:
    """docs: labelled rows only; rows without a language or text are left out.  For each language the rows are tried in
    the order of a hash of id and text, so null and repeated ids are no matter and reruns agree: at most `rows` of them
    are collected, and their texts give at most `chars` characters, fewer if ALL_CHARS shared by all languages is less
    (the bounds are parameters).  No such row gives a model that says und."""
    known = docs.where(F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0))
    h = F.xxhash64(F.lit("lang"), F.col(id_col).cast("string"), F.col(text_col))
    counts = {r[0]: (r["n"], r["low"]) for r in known.select(lang_col, h.alias("h")).groupBy(lang_col).agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).collect()}
    if not counts:
        return LanguageModel.fit({})
    chars = min(chars, max(1, ALL_CHARS // len(counts)))
    # the hash threshold of a language lets through about 2 * rows of its rows, its first one always; rows with the same
    # hash have the same text, and count once
    share, low = F.lit(0.0), F.lit(None).cast("long")
    for lang, (n, first) in counts.items():
        share = F.when(F.col(lang_col) == lang, F.lit(min(1.0, 2.0 * rows / n))).otherwise(share)
        low = F.when(F.col(lang_col) == lang, F.lit(first)).otherwise(low)
    mark = F.pmod(h, F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = known.where((mark < share) | (h == low)).select(lang_col, h.alias("h"), F.substring(text_col, 1, chars).alias("t"))
    texts: dict[str, list[str]] = {lang: [] for lang in counts}
    for r in sorted(sample.dropDuplicates([lang_col, "h"]).collect(), key=lambda r: (r[0], r[1], r[2])):
        if len(texts[r[0]]) < rows:
            texts[r[0]].append(r[2])
    return LanguageModel.fit({lang: "\n".join(_spread(t, chars)) for lang, t in texts.items()})


def _spread(texts: list[str], chars: int) -> list[str]:
    """The beginnings of the texts, chars characters together at most, in equal shares; what short texts leave over goes
    to the longer ones."""
    out, left = {}, chars
    for k, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        out[i] = texts[i][: left // (len(texts) - k)]
        left -= len(out[i])
    return [out[i] for i in range(len(texts))]


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs and the columns lang_pred, score (which replace columns of that name).  See LanguageModel.predict for null,
    empty and letterless texts; whole texts are read, whatever their length; repeated rows get the same answer."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by ALL_CHARS

    def run(batches):
        for batch in batches:
            langs, scores, _ = shared.value.predict(batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_col: str = "lang",
               languages: list[str] | None = None, foreign: float = FOREIGN) -> DataFrame:
    """The rows of docs whose text is in a language of the model (of `languages`, if given), with the prediction in
    lang_col where docs has that column; other columns as they are.  A row goes if its text is null or has no letter, or
    needs over `foreign` times the phrases that text of the predicted language needs (texts of under LEAST symbols say
    too little, and stay).  A model that learned nothing rejects only rows without a letter and predicts nothing."""
    docs_schema, at = docs.schema, docs.columns.index(text_col)
    to = docs.columns.index(lang_col) if lang_col in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, _, ratios = m.predict(texts)
            if m.languages:
                keep = [x != "und" and r <= foreign and (languages is None or x in languages) for x, r in zip(langs, ratios, strict=True)]
                if to is not None:
                    batch = batch.set_column(to, batch.schema.field(to), pa.array(langs, batch.schema.field(to).type))
            else:
                keep = [bool(t) and m._has_letter(t) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs_schema)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    python_side(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

