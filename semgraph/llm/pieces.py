"""SentencePiece: encoding and decoding over distinct chunks, token counts at every prefix.

A chunk is a run of white-space markers with what follows up to the next marker. Where no piece of
the model has a marker after another character, a merge never crosses a chunk's start, so the ids of
a text are those of its chunks in order. Each task keeps a table of the distinct chunks it has met and
segments each of them once; positions are joined to it by look-up inside the task. A table of the
distinct chunks of the whole corpus would give the same ids, but joining it would shuffle one row per
word of the corpus in both directions, several times the size of the texts.
"""

from __future__ import annotations

import re
import sys
import types
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, digest, free_name, table

QUERIES = Queries()

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

# Chunks that a worker remembers from each of the last two stretches of text; those not met in either are
# forgotten, which costs time and no exactness.
REMEMBERED = 150_000
# Pairs of pieces that a worker remembers.
PAIRS = 500_000
# Characters whose chunks are looked up together.
PORTION = 1_000_000


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model and the tables of distinct chunks and pairs of pieces seen by this worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = self.library.id_to_piece(list(range(size)))
        special = [i for i in range(size) if self.library.is_control(i) or self.library.is_unknown(i)
                   or self.library.is_byte(i) or self.library.is_unused(i)]
        self.vocabulary = {name: i for i, name in enumerate(names)}
        for i in special:
            self.vocabulary.pop(names[i], None)
        if any(MARK in name.lstrip(MARK) for name in self.vocabulary):
            raise ValueError("pieces of this model cross white-space markers")
        if self.library.encode("  a  b ") != [i for c in CHUNK.findall(f"{MARK}  a  b ".replace(" ", MARK))
                                              for i in self._segment([c])[0]]:
            raise ValueError("the model changes white space; chunks do not give its ids")
        # length of the longest piece by its last characters, three at most
        self.reach: dict[str, int] = {}
        for name in self.vocabulary:
            self.reach[name[-3:]] = max(len(name), self.reach.get(name[-3:], 0))
        self.ids: dict[str, bytes] = {}
        self.prefixes: dict[str, bytes] = {}
        self.earlier: dict[int, dict[str, bytes]] = {}
        self.fits: dict[int, bool] = {}
        self.names: list[str] = names
        self.shown: list[bytes] | None = None

    def _segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that start with a marker: the library puts one before each text."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if c != MARK else [self.library.piece_to_id(MARK)] for c, ids in zip(chunks, found)]

    def chunks(self, text: str) -> list[str]:
        return CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn_ids(self, chunks: Iterable[str]) -> None:
        """Enters the ids of chunks, as int32."""
        new = list(chunks)
        for chunk, ids in zip(new, self._segment(new)):
            self.ids[chunk] = array("i", ids).tobytes()

    def portions(self, texts: Iterable[str], learn: Callable[[Iterable[str]], None],
                 known: dict[str, bytes]) -> Iterator[list[str]]:
        """The chunks of each text, once their distinct ones are in the table ``known``."""
        def learnt() -> Iterator[list[str]]:
            earlier = self.earlier.setdefault(id(known), {})
            if len(known) > REMEMBERED:
                earlier.clear()
                earlier.update(known)
                known.clear()
            if len(self.fits) > PAIRS:
                self.fits.clear()
            new = set().union(*held).difference(known)
            known.update({c: earlier[c] for c in new & earlier.keys()})
            learn(new.difference(earlier))
            return iter(held)

        held, size = [], 0
        for text in texts:
            held.append(self.chunks(text))
            size += len(text)
            if size > PORTION:
                yield from learnt()
                held, size = [], 0
        yield from learnt()

    def all_ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as int32, joined by position from the table of distinct chunks."""
        for chunks in self.portions(texts, self.learn_ids, self.ids):
            yield b"".join([self.ids[c] for c in chunks])

    def all_counts(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Token counts of every prefix of each text, from the empty one to the whole."""
        for chunks in self.portions(texts, self.learn_counts, self.prefixes):
            yield self.text_counts(chunks)

    def text_of(self, ids: np.ndarray) -> str:
        """Text of ids: the bytes of their pieces, less the marker that encoding puts in front.
        Ids that only the library can show (unknown pieces, broken UTF-8) go to the library."""
        if self.shown is None:
            special = {i: b"" for i in range(len(self.names)) if self.library.is_control(i)}
            single = {i: bytes([int(self.names[i][3:5], 16)]) for i in range(len(self.names))
                      if self.library.is_byte(i)}
            self.shown = [special.get(i, single.get(i, name.replace(MARK, " ").encode()))
                          for i, name in enumerate(self.names)]
        unknown = self.library.unk_id()
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.shown) or (ids == unknown).any()):
            return self.library.decode(ids.tolist())
        parts = [self.shown[i] for i in ids.tolist()]
        try:
            text = b"".join(parts).decode()
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())
        return text[1:] if next((p for p in parts if p), b"")[:1] == b" " else text

    # Prefix counts ------------------------------------------------------------------------------

    def _pair_fits(self, last: int, piece: int) -> bool:
        """Whether the library splits the two pieces' joint text into just these two; -1: no piece
        before. A line feed in front keeps the marker that the library adds out of the merges."""
        pair = [piece] if last < 0 else [last, piece]
        return self.library.encode("\n" + "".join([self.names[p] for p in pair]))[2:] == pair

    def learn_counts(self, chunks: Iterable[str]) -> None:
        """Enters token counts of all prefixes of chunks, shortest first, as int32.

        The last piece of a prefix is the one piece ending there that goes with the last piece of
        the rest; a pair goes together if encoding its joint text gives the pair. A character
        outside the vocabulary becomes its bytes, which never merge. In sorted order, chunks take
        over what their common start with the one before has already shown.
        """
        vocabulary, fits, reach, table = self.vocabulary, self.fits, self.reach, self.prefixes
        before, last, count = "", [-1], [0]
        for chunk in sorted(chunks):
            n, same = len(chunk), 0
            for a, b in zip(before, chunk):
                if a != b:
                    break
                same += 1
            del last[same + 1:], count[same + 1:]
            for end in range(same + 1, n + 1):
                start = end - reach.get(chunk[end - 3:end], 2) if end > 2 else 0
                for start in range(start if start > 0 else 0, end):
                    piece = vocabulary.get(chunk[start:end])
                    if piece is None:
                        continue
                    pair = (last[start] + 1) << 24 | piece
                    good = fits.get(pair)
                    if good is None:
                        good = fits[pair] = self._pair_fits(last[start], piece)
                    if good:
                        last.append(piece)
                        count.append(count[start] + 1)
                        break
                else:
                    if chunk[end - 1] in vocabulary:
                        raise ValueError("no piece ends this prefix; the model is not a merge model")
                    last.append(-1)
                    count.append(count[end - 1] + len(chunk[end - 1].encode()))
            table[chunk] = array("i", count[1:]).tobytes()
            before = chunk

    def text_counts(self, chunks: list[str]) -> np.ndarray:
        table = self.prefixes
        own = np.frombuffer(b"".join([table[c] for c in chunks]), np.int32).astype(np.int64)
        if not len(own):
            return np.zeros(1, np.int64)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        before = np.concatenate([[0], np.cumsum(own[ends - 1])[:-1]])
        counts = own + np.repeat(before, np.diff(ends, prepend=0))
        counts[0] = 0  # the marker alone: the library gives nothing for the empty text
        return counts


def _pieces(path: str) -> Pieces:
    """The model of this worker, with what it has learnt. It is held in a module made at run time, as
    functions that travel by value bring new globals to each task."""
    held = sys.modules.setdefault("semgraph_worker", types.ModuleType("semgraph_worker")).__dict__
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def _portions(column: pa.Array) -> Iterator[list[str]]:
    """Texts of a batch, about ``PORTION`` bytes at a time; null counts as empty."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.searchsorted(sizes, np.arange(PORTION, int(sizes[-1]) if len(sizes) else 0, PORTION)) + 1)
    for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(column)]):
        if end > start:
            yield [t or "" for t in column.slice(start, end - start).to_pylist()]


def _lists(parts: list[bytes]) -> pa.Array:
    """One list of int32 for each string of bytes."""
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(text: Column, model: str | None = None, add_end: bool = True) -> Column:
    """Ids of the text as the library gives them, ``array<int>``; null counts as empty.

    Texts of any length, U+2581 itself and characters outside the vocabulary are encoded as the
    library does. ``add_end`` appends the end id.
    """
    path = model or default_model()

    @F.arrow_udf("array<int>")
    def ids_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(path)
        end = np.array([pieces.library.eos_id()] * add_end, np.int32).tobytes()
        for column in columns:
            for texts in _portions(column):
                yield _lists([ids + end for ids in pieces.all_ids(texts)])
    return ids_of.asNondeterministic()(text)


def round_trip(text: Column, model: str | None = None) -> Column:
    """``struct<ids, decoded>``: ``encode`` with an end id, and the text that ``decode`` makes of the
    ids, both in one pass of the task. Each portion goes back by itself, so that neither the worker nor the
    executor holds the results of a whole batch."""
    path = model or default_model()

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces = _pieces(path)
        end = np.array([pieces.library.eos_id()], np.int32).tobytes()
        for column in columns:
            for texts in _portions(column):
                coded = [part + end for part in pieces.all_ids(texts)]
                decoded = pa.array([pieces.text_of(np.frombuffer(c, np.int32)) for c in coded], pa.string())
                yield pa.StructArray.from_arrays([_lists(coded), decoded], names=["ids", "decoded"])
    return both.asNondeterministic()(text)


def decode(ids: Column, model: str | None = None) -> Column:
    """Text of the ids as the library's ``decode(ids)`` gives it; null counts as no ids."""
    path = model or default_model()

    @F.arrow_udf("string")
    def text_of(column: pa.Array) -> pa.Array:
        pieces = _pieces(path)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(
            column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array([pieces.text_of(flat[start:end]) for start, end in
                         zip([0, *ends[:-1].tolist()], ends.tolist())], pa.string())
    return text_of.asNondeterministic()(ids)


def prefix_counts(text: Column, model: str | None = None) -> Column:
    """Token counts of all prefixes of the text, ``array<int>`` from the empty prefix to the whole
    text, without begin or end ids: element k (from 0) is the count of the first k characters."""
    path = model or default_model()

    @F.arrow_udf("array<int>")
    def counts_of(column: pa.Array) -> pa.Array:
        pieces = _pieces(path)
        return pa.concat_arrays([_lists([]), *(_lists([c.astype(np.int32).tobytes() for c in pieces.all_counts(texts)])
                                               for texts in _portions(column))])
    return counts_of.asNondeterministic()(text)


def token_count(text: Column, budget: int, model: str | None = None) -> Column:
    """``struct<n_tokens long, fit_chars long>`` read off the prefix counts inside the task: the
    count of the whole text, and the length of the longest prefix of at most ``budget`` tokens."""
    path = model or default_model()

    @F.arrow_udf("struct<n_tokens: bigint, fit_chars: bigint>")
    def answers(column: pa.Array) -> pa.Array:
        pieces = _pieces(path)
        whole, fit = [], []
        for counts in (c for texts in _portions(column) for c in pieces.all_counts(texts)):
            whole.append(int(counts[-1]))
            fit.append(int(np.flatnonzero(counts <= budget)[-1]))
        return pa.StructArray.from_arrays([pa.array(whole, pa.int64()), pa.array(fit, pa.int64())],
                                          names=["n_tokens", "fit_chars"])
    return answers.asNondeterministic()(text)


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """All columns of ``docs`` with ``ids`` (an end id included), ``n_tokens`` and ``decoded`` appended.

    A null text counts as empty; columns of those names get underscores before the new ones.
    """
    ids, n, decoded, both = (free_name(docs.columns, name) for name in ("ids", "n_tokens", "decoded", "round_trip"))
    coded = docs.withColumn(both, round_trip(F.col("text"), model))
    return coded.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{both}`.ids").alias(ids),
                        F.size(f"`{both}`.ids").cast("long").alias(n), F.col(f"`{both}`.decoded").alias(decoded))


@QUERIES.add("op4_sentencepiece")
def op4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    both = docs.select("doc_id", round_trip(F.col("text")).alias("r")).select("doc_id", "r.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                       digest(F.col("decoded")).alias("decoded_sha256"))


@QUERIES.add("op7_token_counts")
def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                          token_count(F.col("text"), 4096).alias("t"))
    return counted.select("doc_id", "n_bytes", "t.n_tokens", (F.col("t.n_tokens") > 4096).alias("over_limit"),
                          "t.fit_chars")
