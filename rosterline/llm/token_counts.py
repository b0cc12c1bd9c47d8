"""Exact token counts of every prefix, by dynamic programming over prefixes.

For a byte-pair vocabulary with word ends, the encoding of a prefix is the encoding of a shorter
prefix plus one last token, and that token is the only one whose pair with the token before it
survives the merges. So the state of a prefix (its last token and its count) follows from one
earlier state. States are kept per word prefix and shared by all words that begin alike; a word
longer than the longest token keeps its last states by position instead. A text's counts are sums
over its words. Truncation and budget questions are then lookups in a stored array
of counts: ``tokens_at`` and ``fitting_prefix`` encode nothing.

Positions count code points of the normalised text (as the tokenizer normalises it). Special
strings inside a text count as one token each, the library's default; a prefix that ends inside
one is ordinary text. Nulls: a null text is empty and has no tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

PLAIN = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")
#: A piece of visible ASCII without an apostrophe or "<" needs no library call to be cut.
SIMPLE = re.compile(r"[!-%(-;=-~]+")
CACHED_CHARS, CACHE_PIECES = 64, 1_000_000

_counters: dict[str, PrefixCounter] = {}


class PrefixCounter:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str
        self.pre_tokenize = library.pre_tokenizer.pre_tokenize_str
        specials = [t.content for t in library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")")
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.vocabulary = model["vocab"].keys()
        self.end = model["end_of_word_suffix"]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocabulary)
        self._clear()

    def _clear(self) -> None:
        self.survives: dict[tuple[str, str], bool] = {}
        self.open: dict[str, tuple[str, int]] = {"": ("", 0)}
        self.pieces: dict[str, int] = {}

    def _merge(self, first: str, second: str) -> bool:
        """Whether the merges leave the two tokens' symbols as exactly these two tokens."""
        last = [*second.removesuffix(self.end)]
        if second.endswith(self.end) and len(second) > len(self.end):
            last[-1] += self.end
        symbols, rank = [*first, *last], self.rank
        while len(symbols) > 1:
            best, at = min(
                (rank.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
            )
            if best == 1 << 60:
                break
            a, b = symbols[at], symbols[at + 1]
            merged, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                    merged.append(a + b)
                    i += 2
                else:
                    merged.append(symbols[i])
                    i += 1
            symbols = merged
        return symbols == [first, second]

    def _fits(self, first: str, second: str) -> bool:
        if not first:
            return True
        key = (first, second)
        if key not in self.survives:
            self.survives[key] = self._merge(first, second)
        return self.survives[key]

    def _last(
        self, word: str, end: int, ending: str, state: Callable[[int], tuple[str, int]]
    ) -> tuple[str, int]:
        """Last token and count of ``word[:end]``, open (no ending) or as a whole word.

        ``state`` gives the open state of a shorter prefix by its length.
        """
        for at in range(max(0, end - self.longest), end):
            token = word[at:end] + ending
            if token in self.vocabulary:
                last, count = state(at)
                if self._fits(last, token):
                    return token, count + 1
        raise ValueError("the vocabulary lacks a byte")

    def _state(self, word: str, ending: str) -> tuple[str, int]:
        """``_last`` of a word no longer than the longest token, from states kept by prefix."""
        return self._last(word, len(word), ending, lambda at: self.opened(word[:at]))

    def opened(self, prefix: str) -> tuple[str, int]:
        """State of a short word prefix that goes on."""
        state = self.open.get(prefix)
        if state is None:
            state = self.open[prefix] = self._state(prefix, "")
        return state

    def long_word(self, word: str, ends: Sequence[int]) -> list[int]:
        """Tokens of ``word[:end]`` as a word for each of the ascending ``ends``.

        A state looks back over the longest token only, so that many states are kept, by position.
        """
        ring = self.longest + 1
        lasts, counts = [""] * ring, [0] * ring

        def state(at: int) -> tuple[str, int]:
            return lasts[at % ring], counts[at % ring]

        out, done = [], 0
        for end in ends:
            for n in range(done + 1, end):
                lasts[n % ring], counts[n % ring] = self._last(word, n, "", state)
            out.append(self._last(word, end, self.end, state)[1])
            if end < ends[-1]:
                lasts[end % ring], counts[end % ring] = self._last(word, end, "", state)
            done = end
        return out

    def word(self, word: str) -> int:
        """Tokens of one word (in byte characters) that ends here."""
        if max(len(self.pieces), len(self.open) // 2) > CACHE_PIECES:
            self._clear()
        if len(word) > self.longest:
            return self.long_word(word, [len(word)])[0]
        return self._state(word, self.end)[1]

    def _words(self, part: str) -> list[str]:
        return [w for w, _ in self.pre_tokenize(self.normalize(part))]

    def piece(self, piece: str) -> int:
        """Tokens of a piece without a plain space."""
        count = self.pieces.get(piece)
        if count is not None:
            return count
        if SIMPLE.fullmatch(piece):
            count = sum(map(self.word, PLAIN.findall(piece.lower())))
        else:
            count = 0
            for i, part in enumerate(self.special.split(piece)):
                count += 1 if i % 2 else sum(map(self.word, self._words(part)))
        if len(piece) <= CACHED_CHARS:
            self.pieces[piece] = count
        return count

    def total(self, text: str) -> int:
        return sum(map(self.piece, text.split(" ")))

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of all prefixes, the empty one first, by code points of the normal form."""
        out, done = [0], 0
        for i, part in enumerate(self.special.split(text)):
            shown, base = self.normalize(part), len(out) - 1
            for word, (low, high) in self.pre_tokenize(shown):
                out += [done] * (base + low - len(out) + 1)  # white space between words
                piece, at = shown[low:high], 0
                if len(word) > self.longest:
                    ends = np.cumsum([len(c.encode()) for c in piece]).tolist()
                    out += [done + n for n in self.long_word(word, ends)]
                    done = out[-1]
                    continue
                for n in range(1, high - low + 1):
                    at += len(piece[n - 1].encode())
                    if piece[0] == "'" and n < high - low:  # part of a contraction
                        words = [w for w, _ in self.pre_tokenize(piece[:n])]
                    else:
                        words = [word[:at]]
                    out.append(done + sum(map(self.word, words)))
                done = out[-1]
            out += [done] * (base + len(shown) - len(out) + 1)
            if i % 2:  # a whole special string is one token
                done = out[base] + 1
                out[-1] = done
        return np.array(out, dtype=np.int32)


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    limit: int = 2048,
    every_prefix: bool = False,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    With ``every_prefix`` also ``counts``: the token count of every prefix, as an array whose
    entry k belongs to the first k code points. Without it only the last entry is kept.
    """
    small_batches(docs.sparkSession)
    kind = "id long, n_bytes long, n_tokens long" + ", counts array<int>" * every_prefix

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = counter(tokenizer_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if every_prefix:
                counts = [table.prefixes(t) for t in texts]
                totals = [int(c[-1]) for c in counts]
                extra = [pa.array(counts, pa.list_(pa.int32()))]
            else:
                totals, extra = [table.total(t) for t in texts], []
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(totals, pa.int64()), *extra],
                ["id", "n_bytes", "n_tokens", "counts"][: 3 + len(extra)],
            )

    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"),
        text.alias("text"),
    ).mapInArrow(count, kind)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit).withColumnRenamed("id", id_col)


def tokens_at(counts: Column, position: Column) -> Column:
    """Tokens of the first ``position`` code points (of the whole text where it is shorter)."""
    return F.get(counts, F.greatest(F.lit(0), F.least(position, F.size(counts) - 1)))


def fitting_prefix(counts: Column, budget: Column) -> Column:
    """The longest prefix, in code points, that has at most ``budget`` tokens."""
    fits = F.filter(F.sequence(F.lit(0), F.size(counts) - 1), lambda i: F.get(counts, i) <= budget)
    return F.array_max(fits)
