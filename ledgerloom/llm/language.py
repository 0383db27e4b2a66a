"""Language identification by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm.shared import blocks, frugal, pieces, small_or_stored

#: Label of texts that are null or have no letter.
UNKNOWN = "und"
#: Hashed features, and the most letters of a token; longer words are several tokens.
BUCKETS, LETTERS = 1 << 16, 30
#: Tokens labelled in one go. Longer chains are cut, and the pieces get the messages of what lies around them, so the cut changes nothing.
SPAN = 1024
_LETTERS = re.compile(r"[^\W\d_]+")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def letters(word: bytes) -> list[str]:
    """The word's letters (Unicode's categories L) in lower case, as tokens of at most LETTERS each; none if it has no letter."""
    found = "".join(_LETTERS.findall(word.decode()))
    if not found.isalpha():  # numbers such as ² and Ⅷ
        found = "".join(filter(str.isalpha, found))
    found = found.lower()
    return [found[i : i + LETTERS] for i in range(0, len(found), LETTERS)]


def tokens(text: bytes) -> list[str]:
    """The tokens of all words of a text."""
    return [x for w in text.split() for x in letters(w)]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, value) entries: n-grams of one to three signs with marked ends, affixes of three letters, lexicon entries."""
    n = len(words)
    width = LETTERS + 2
    signs = np.zeros((n, width), np.uint64)
    size = np.fromiter(map(len, words), np.int64, n)
    signs[:, 1 : LETTERS + 1] = np.array(words, f"U{LETTERS}").view(np.uint32).reshape(n, LETTERS)
    signs[:, 0] = 2
    signs[np.arange(n), size + 1] = 3
    places = np.arange(width)[None, :]
    of, at, values = [], [], []
    for k, bound in ((1, size), (2, size + 1), (3, size), (4, size - 1)):
        value = np.full((n, width - k + 1), k, np.uint64)
        for j in range(k):
            value = (value ^ signs[:, j : width - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        start = places[:, : width - k + 1]
        if k == 1:
            inside = (start >= 1) & (start <= bound[:, None])
        elif k < 4:
            inside = start < bound[:, None]
        else:  # affixes: the first and the last three letters with their end mark
            inside = ((start == 0) | (start == bound[:, None] - 1)) & (bound[:, None] > 0)
        row, col = np.nonzero(inside)
        of.append(row)
        at.append((value[row, col] % np.uint64(BUCKETS)).astype(np.int64))
        values.append((1 / np.sqrt(np.maximum(inside.sum(axis=1), 1)))[row])
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, n)
    row = np.flatnonzero(known >= 0)
    return np.concatenate([*of, row]), np.concatenate([*at, BUCKETS + known[row]]), np.concatenate([*values, np.ones(len(row))])


def forward_backward(
    scores: np.ndarray, steps: np.ndarray, start: np.ndarray, sizes: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word given the words up to it, and given all words.

    ``scores`` is (time, sequence, label), padded behind each sequence's size;
    ``steps`` holds transition scores from row to column. Sequences that are cut
    from longer ones have the messages of what lies before and behind them
    (``before`` has NaN where a sequence begins).
    """
    n = len(scores)
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(steps - steps.max())
    ahead, behind = np.empty_like(local), np.ones_like(local)
    first = np.broadcast_to(np.exp(start - start.max()), local[0].shape)
    if before is not None:
        first = np.where(np.isnan(before), first, before @ move)
    if after is not None:
        behind[sizes - 1, np.arange(len(sizes))] = after
    ahead[0] = local[0] * first
    ahead[0] /= ahead[0].sum(axis=1, keepdims=True)
    for t in range(1, n):
        a = (ahead[t - 1] @ move) * local[t]
        ahead[t] = a / a.sum(axis=1, keepdims=True)
    inside = np.arange(n)[:, None] + 1 < sizes[None, :]  # the next word exists
    for t in range(n - 2, -1, -1):
        b = (behind[t + 1] * local[t + 1]) @ move.T
        behind[t] = np.where(inside[t][:, None], b / b.sum(axis=1, keepdims=True), behind[t])
    out = ahead * behind
    return ahead, out / out.sum(axis=2, keepdims=True)


def transfers(scores: np.ndarray, steps: np.ndarray, sizes: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """(sequence, label, label): what each sequence makes of a message that reaches it; ``opens`` marks those that begin a text."""
    local, move = np.exp(scores - scores.max(axis=2, keepdims=True)).astype(np.float64), np.exp(steps - steps.max()).astype(np.float64)
    state = np.broadcast_to(np.eye(scores.shape[2]), (scores.shape[1], *steps.shape)).copy()
    for t in range(len(scores)):
        moved = state @ move if t else np.where(opens[:, None, None], state, state @ move)
        moved = moved * local[t][:, None, :]
        state = np.where((t < sizes)[:, None, None], moved / moved.sum(axis=(1, 2), keepdims=True), state)
    return state


def pair_counts(ahead: np.ndarray, gamma: np.ndarray, steps: np.ndarray, time: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Expected number of steps between each two labels; (time, seq) are the words that follow another."""
    joint = ahead[time - 1, seq][:, :, None] * np.exp(steps)[None]
    joint *= (gamma[time, seq] / np.maximum(joint.sum(axis=1), 1e-300))[:, None, :]
    return joint.sum(axis=0)


@dataclass
class Crf:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Score of each label for each word; zeros for words without letters."""
        out = np.zeros((len(words), len(self.labels)))
        for at in range(0, len(words), 8000):
            row, feature, value = features(words[at : at + 8000], self.lexicon)
            m = len(words[at : at + 8000])
            for k in range(len(self.labels)):
                out[at : at + m, k] = np.bincount(row, self.weights[feature, k] * value, m)
        return out

    @staticmethod
    def fit(documents: list[tuple[str, str]], seed: int = 5, epochs: int = 3, lexicon_size: int = 4000) -> Crf:
        """Fits on (text, language) documents, with every token of each.

        Texts are cut into sequences of 5 to 24 tokens. To one in three a
        stretch of another document is spliced, so that transitions are learned
        for code-switched text. Gradients are expected feature counts by
        forward-backward, steps are AdaGrad's.
        """
        rng = np.random.default_rng(seed)
        labels = sorted({lang for _, lang in documents})
        of = {lang: i for i, lang in enumerate(labels)}
        split = [(tokens(text.encode()), of[lang]) for text, lang in documents]
        split = [(w, k) for w, k in split if w]
        counts = Counter(x for w, _ in split for x in set(w))
        lexicon = {w: i for i, w in enumerate(sorted((w for w, c in counts.items() if c >= 5), key=lambda w: (-counts[w], w))[:lexicon_size])}
        crf = Crf(labels, lexicon, np.zeros((BUCKETS + len(lexicon), len(labels))), np.zeros((len(labels),) * 2), np.zeros(len(labels)))
        if not split or len(labels) < 2:
            return crf
        cut = []
        for words, k in split:
            at = 0
            while at < len(words):
                size = int(rng.integers(5, 25))
                own, gold = words[at : at + size], [k] * len(words[at : at + size])
                if rng.random() < 1 / 3:
                    more, other = split[rng.integers(len(split))]
                    start, n = int(rng.integers(max(1, len(more) - 5))), int(rng.integers(5, 25))
                    own, gold = own + more[start : start + n], gold + [other] * len(more[start : start + n])
                cut.append((own, gold))
                at += size
        squares = [np.full_like(p, 1e-3) for p in (crf.weights, crf.steps, crf.start)]
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(cut)), max(1, len(cut) // 64)):
                crf._step([cut[i] for i in batch], squares)
        return crf

    def _step(self, batch: list[tuple[list[str], list[int]]], squares: list[np.ndarray], rate: float = 0.15) -> None:
        sizes = np.array([len(w) for w, _ in batch])
        flat = [x for w, _ in batch for x in w]
        gold = np.array([k for _, g in batch for k in g])
        seq = np.repeat(np.arange(len(batch)), sizes)
        time = np.concatenate([np.arange(n) for n in sizes])
        row, feature, value = features(flat, self.lexicon)
        n_labels = len(self.labels)
        scores = np.zeros((int(sizes.max()), len(batch), n_labels))
        for k in range(n_labels):
            scores[time, seq, k] = np.bincount(row, self.weights[feature, k] * value, len(flat))
        ahead, gamma = forward_backward(scores, self.steps, self.start, sizes)
        target = np.zeros_like(gamma)
        target[time, seq, gold] = 1
        error = (gamma - target)[time, seq]
        used, at = np.unique(feature, return_inverse=True)
        gradient = np.stack([np.bincount(at, error[row, k] * value, len(used)) for k in range(n_labels)], axis=1) / len(batch)
        both = time > 0
        pair = pair_counts(ahead, gamma, self.steps, time[both], seq[both])
        np.add.at(pair, (gold[np.flatnonzero(both) - 1], gold[both]), -1)
        first = error[time == 0].sum(axis=0)
        for p, g, s, where in ((self.weights, gradient, squares[0], used), (self.steps, pair / len(batch), squares[1], slice(None)), (self.start, first / len(batch), squares[2], slice(None))):
            s[where] += g * g
            p[where] -= rate * g / np.sqrt(s[where])


def fit_languages(
    docs: DataFrame, most: int = 150, preferred: int = 1 << 15, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> Crf:
    """Fits on at most ``most`` documents of each language outside the held-out fold, on all of their texts.

    So a rare language is learned too. They are those with the least hash of
    the id among the texts of at most ``preferred`` bytes; longer ones only
    fill up, since the sample passes the driver.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.coalesce(fold(id_col, folds) != held_fold, F.lit(False)))
    order = ["long", "h", "text"]
    known = known.select(F.xxhash64(id_col, F.lit(1)).alias("h"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), (F.octet_length(text_col) > preferred).alias("long"))
    counts = small_or_stored(known.groupBy("lang", "long").agg(F.count(F.lit(1)).alias("n")), "languages")
    # a share that leaves some more than enough of each language, so that few texts are put in order
    share = F.pmod("h", F.lit(1 << 20)) <= F.lit(3.0 * most * (1 << 20)) / F.col("n")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    rows = known.join(counts, ["lang", "long"]).where(share).withColumn("rank", rank).where(F.col("rank") <= most)
    sample = rows.select("h", "lang", "text").toArrow().sort_by([("h", "ascending"), ("lang", "ascending"), ("text", "ascending")])
    return Crf.fit(list(zip(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), strict=True)))


class _Words:
    """Emissions of the tokens that a task has met, up to bounds of tokens and bytes; the worker keeps nothing for the next task."""

    def __init__(self, crf: Crf, most: int = 200_000, most_bytes: int = 1 << 25):
        self.crf, self.most, self.most_bytes, self.held = crf, most, most_bytes, 0
        #: for each word the row of its one token, -1 if it has none, or -2 and less for the place of several in ``long``
        self.number: dict[bytes, int] = {}
        self.long: list[np.ndarray] = []
        self.rows, self.used = np.zeros((1024, len(crf.labels)), np.float32), 0

    def age(self) -> None:
        if self.used > self.most or self.held > self.most_bytes:
            self.number.clear()
            self.long.clear()
            self.used = self.held = 0

    def of(self, values: list[bytes]) -> list[np.ndarray]:
        """Row numbers of each text's tokens."""
        split = [v.split() for v in values]
        if new := [w for w in set().union(*split) if w not in self.number]:
            flat: list[str] = []
            self.held += sum(map(len, new)) + 100 * len(new)
            for w in new:
                own = letters(w)
                at = self.used + len(flat)
                flat += own
                self.number[w] = at if len(own) == 1 else -1
                if len(own) > 1:
                    self.long.append(np.arange(at, at + len(own), dtype=np.int32))
                    self.number[w] = -1 - len(self.long)
            while len(self.rows) < self.used + len(flat):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : self.used + len(flat)] = self.crf.emissions(flat)
            self.used += len(flat)
        out = []
        for words in split:
            ids = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
            if len(ids) and ids.min() < -1:
                ids = np.concatenate([self.long[-2 - i] if i < -1 else np.array([i], np.int32) for i in ids.tolist()])
            out.append(ids[ids >= 0])
        return out


def _like_sized(parts: list[tuple[int, int, int]], most: int) -> Iterator[list[int]]:
    """Numbers of parts (text, start, end) of like length, that together take no more than about ``most`` words when padded."""
    order = sorted(range(len(parts)), key=lambda p: parts[p][2] - parts[p][1])
    at = 0
    while at < len(order):
        least, end = parts[order[at]][2] - parts[order[at]][1], at + 1
        while end < len(order) and (size := parts[order[end]][2] - parts[order[end]][1]) <= 1.25 * least + 4 and (end - at + 1) * size <= most:
            end += 1
        yield order[at:end]
        at = end


def _padded(rows: np.ndarray, ids: list[np.ndarray], parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([b - a for _, a, b in parts])
    out = np.zeros((int(sizes.max()), len(parts), rows.shape[1]), np.float32)
    for k, (i, a, b) in enumerate(parts):
        out[: b - a, k] = rows[ids[i][a:b]]
    return out, sizes


def _messages(crf: Crf, rows: np.ndarray, ids: list[np.ndarray], parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """What reaches each part of a text from before and from behind."""
    k = len(crf.labels)
    before, after = np.full((len(parts), k), np.nan), np.ones((len(parts), k))
    cut = [p for p, (i, a, b) in enumerate(parts) if b - a < len(ids[i])]
    through = np.zeros((len(parts), k, k))
    for group in _like_sized([parts[p] for p in cut], 100_000):
        own = [cut[g] for g in group]
        scores, sizes = _padded(rows, ids, [parts[p] for p in own])
        through[own] = transfers(scores, crf.steps, sizes, np.array([parts[p][1] == 0 for p in own]))
    for p in cut:
        if parts[p][1] == 0:
            message = np.exp(crf.start - crf.start.max())
        else:
            before[p] = message
        message = message @ through[p]
        message = message / message.sum()
    for p in reversed(cut):
        if parts[p][2] == len(ids[parts[p][0]]):
            message = np.ones(k)
        after[p] = message
        message = through[p] @ message
        message = message / message.sum()
    return before, after


def _predict(crf: Crf, rows: np.ndarray, ids: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Label and score of each text. Chains of like length run together; longer ones than SPAN are cut, with the messages across the cuts."""
    parts = [(i, a, min(len(x), a + SPAN)) for i, x in enumerate(ids) for a in range(0, len(x), SPAN)]
    before, after = _messages(crf, rows, ids, parts)
    sums = np.zeros((len(ids), len(crf.labels)))
    for own in _like_sized(parts, 150_000):
        padded, sizes = _padded(rows, ids, [parts[p] for p in own])
        _, gamma = forward_backward(padded, crf.steps.astype(np.float32), crf.start.astype(np.float32), sizes, before[own], after[own])
        inside = np.arange(len(padded))[:, None] < sizes
        np.add.at(sums, [parts[p][0] for p in own], (gamma * inside[:, :, None]).sum(axis=0, dtype=np.float64))
    total = sums.sum(axis=1)
    mean = sums / np.maximum(total, 1)[:, None]
    names = [crf.labels[k] if t > 0 else UNKNOWN for k, t in zip(mean.argmax(axis=1).tolist(), total.tolist(), strict=True)]
    return names, np.minimum(1.0, mean.max(axis=1, initial=0.0))


def identify(docs: DataFrame, crf: Crf, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (0 to 1), after any columns to ``keep``; ``with_text``, then text_.

    Every word with letters of the whole text is labelled by forward-backward
    (a word of over LETTERS letters as several tokens);
    the language is the one with the largest mean probability, which is the
    score (ties: the first by name). Features are n-grams, affixes and a lexicon,
    all of the text alone. Very long texts are one chain like others, and take
    memory in proportion to their words.

    Null texts and texts without a letter are ``und`` with score 0. A model that
    has seen no language calls every text ``und``, with one language it is always
    that one. Each row is judged for itself; null ids are not held out. Other
    columns are ignored. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(held.value)
        for batch in batches:
            for start, end, values in pieces(batch, "text_", 8 << 20):  # batches of long texts are large
                words.age()
                ids: list[np.ndarray] = []
                for a, b in blocks(values, 1 << 20):
                    ids += words.of(values[a:b])
                n = end - start
                names, scores = _predict(held.value, words.rows, ids) if held.value.labels else ([UNKNOWN] * n, np.zeros(n))
                *kept, own = batch.slice(start, n).columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(scores, pa.float64()), *([own] if with_text else [])], names=out_names)

    out_names = [*[f"keep_{i}" for i in range(len(keep))], "id", "held_out", "lang_pred", "score", *(["text_"] if with_text else [])]
    rows = docs.select(
        *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(id_col).alias("id"),
        F.coalesce(fold(id_col, folds) == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text_"),
    )
    kinds = [*[rows.schema[f"keep_{i}"].dataType.simpleString() for i in range(len(keep))], rows.schema["id"].dataType.simpleString(), "boolean", "string", "double", *(["string"] if with_text else [])]
    found = rows.mapInArrow(frugal(run), ", ".join(f"{n} {k}" for n, k in zip(out_names, kinds, strict=True)))
    return found.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], F.col("id").alias(id_col), "held_out", "lang_pred", "score", *(["text_"] if with_text else []))
