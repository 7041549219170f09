"""Hierarchical multi-length packing.

Documents become token ids (an end id closes each), are routed to context-size tiers, and every tier is packed
from the longest down; gaps of long windows are filled with documents of shorter tiers, whole ones first, then
one that is cut. Within a task the ids wait in groups of bounded size, so there is no shuffle and no state that
grows with the input; a lost task repeats its own rows and gives the same sequences. A group's last, unfilled window
goes on into the next group; only an input partition's last one is cut into shorter powers of two.

Ids are made for slices of an Arrow batch at a time: white space, and in plain texts also a change between letters
and other characters, cuts the texts into chunks; the slice's distinct chunks are encoded once each, and the ids of
all chunks are gathered by offsets.

Cases: a null text is empty (one piece, the end id alone); a null id is kept; repeated ids are packed as
separate documents; an empty table gives no rows; only the id and the text column are read, so other columns
can't clash.
"""

from __future__ import annotations

import array
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import field_ddl, table, text_of

#: Context sizes, the longest first; each a power of two.
TIERS = (4096, 2048, 1024, 512)
#: Documents wait until a group has so many tokens or rows.
GROUP_TOKENS, GROUP_DOCS = 4_000_000, 20_000
#: Tokens of a training step's group of sequences.
STEP_TOKENS = 65_536
END_ID = 2
#: A worker's caches hold so many chunks in the newer and in the older half.
CACHE = 250_000
#: Bytes of text whose chunks are encoded together.
SLICE_BYTES = 8_000_000
#: Texts with these go through the library's whole chain.
ODD = r"<\||[\x1c-\x1f]"
#: Texts with these are cut at white space only: letters beyond Latin or that grow in lower case, and apostrophes beside what is no letter.
MIXED = r"[^\x{0}-\x{12F}\x{131}-\x{24F}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20AC}]|'[^\s\p{L}]|[^\s\p{L}]'"
#: In the others a chunk ends where such a run begins or ends; the pre-tokenizer never joins across its bounds.
BESIDE = r"([^\s\p{L}']+)"

#: What the vocabulary's pre-tokenizer keeps of a text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's table: printable bytes stand for themselves, others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """Ids of whole texts by the tokenizers library, with caches of chunks.

    The vocabulary's normaliser and pre-tokenizer never join across white space, nor across the bounds of BESIDE in
    plain texts, so chunks can be encoded alone. Texts with its special tokens' strings or with control separators,
    and chunks of letters beyond Latin, go through the library's whole chain."""

    far = re.compile("[^\x00-ɏ]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.split, self.letters = self.whole.model, regex.compile(PRETOKEN), byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def full(self, text: str) -> bytes:
        return array.array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of one pre-token, lower-case."""
        found = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(self.letters))
        return array.array("I", [x.id for x in found]).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            ids = self.word(chunk.lower())
        elif self.far.search(chunk):
            ids = self.full(chunk)
        else:
            words = self.split.findall(unicodedata.normalize("NFC", chunk).lower())
            ids = self.word(words[0]) if words == [chunk] else b"".join([self.chunk_ids(w) if w.isalpha() else self.word(w) for w in words])
        return ids

    def chunk_ids(self, chunk: str) -> bytes:
        ids = self.chunks.get(chunk)
        if ids is None:
            ids = self.older.get(chunk)
            if ids is None:
                ids = self.chunk(chunk)
            if len(chunk) < 64:
                self.chunks[chunk] = ids
        return ids

    def slice_ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        import numpy as np
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        plain = pc.if_else(pc.match_substring_regex(plain, MIXED), plain, pc.replace_substring_regex(plain, BESIDE, r" \1 "))
        parts = pc.ascii_split_whitespace(plain)
        coded = parts.flatten().dictionary_encode()
        if len(self.chunks) >= CACHE:
            self.older, self.chunks = self.chunks, {}
        of = [self.chunk_ids(c) for c in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, of), np.int64, len(of)) // 4
        flat, first = np.frombuffer(b"".join(of), "<u4"), np.cumsum(sizes) - sizes
        code = coded.indices.to_numpy()
        n = sizes[code]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.repeat(first[code] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        made = iter([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])])
        return [self.full(texts[k].as_py()) if o else next(made) for k, o in enumerate(odd.tolist())]

    def ids(self, texts: pa.Array) -> Iterator[bytes]:
        """The same for texts of any number and length, in slices of about SLICE_BYTES."""
        import numpy as np
        import pyarrow.compute as pc

        upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(upto, SLICE_BYTES + (upto[at - 1] if at else 0), "right")))
            yield from self.slice_ids(texts.slice(at, to - at))
            at = to


Piece = tuple[int, int, int]  # document, start, length


def pack_group(lengths: list[int], tiers: tuple[int, ...] = TIERS, carried: list[Piece] | None = None, last: bool = True) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences of pieces, and what is left; each sequence's length is a power of two, at most tiers[0].

    carried: what an earlier group left; its documents come first in lengths. Only the last group leaves nothing."""
    top, full = tiers[0], []
    pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending
    known = len({doc for doc, _, _ in carried or []})
    for doc, start, length in carried or []:
        pool.append((length, doc, start))
    for doc in range(known, len(lengths)):
        start, n = 0, lengths[doc]
        while n - start >= top:
            full.append([(doc, start, top)])
            start += top
        if n > start:
            pool.append((n - start, doc, start))
    pool.sort()
    while pool:
        length, doc, start = pool.pop()
        size = next(t for t in reversed(tiers) if length <= t)
        pieces, gap = [(doc, start, length)], size - length
        while gap and pool:
            at = bisect_right(pool, (gap, float("inf"))) - 1
            if at >= 0:
                length, doc, start = pool.pop(at)
                pieces.append((doc, start, length))
                gap -= length
            else:  # no whole one fits: cut the shortest
                length, doc, start = pool.pop(0)
                pieces.append((doc, start, gap))
                insort(pool, (length - gap, doc, start + gap))
                gap = 0
        if not gap:
            full.append(pieces)
        elif last:
            full += powers(pieces, size - gap)
        else:
            return full, pieces
    return full, []


def powers(pieces: list[Piece], total: int) -> list[list[Piece]]:
    """The last, unfilled window, as shorter windows that need no padding."""
    out, queue = [], pieces[::-1]
    while total:
        size = room = 1 << (total.bit_length() - 1)
        now = []
        while room:
            doc, start, length = queue.pop()
            take = min(room, length)
            now.append((doc, start, take))
            if length > take:
                queue.append((doc, start + take, length - take))
            room -= take
        out.append(now)
        total -= size
    return out


def steps(sequences: list[list[Piece]]) -> list[int]:
    """Step group of each sequence: one size a group, attention cost spread by dealing to and fro."""
    by: dict[int, list[int]] = {}
    for k, pieces in enumerate(sequences):
        by.setdefault(sum(p[2] for p in pieces), []).append(k)
    out, first = [0] * len(sequences), 0
    for size, own in sorted(by.items(), reverse=True):
        n = max(1, round(len(own) * size / STEP_TOKENS))
        own.sort(key=lambda k: (-sum(p[2] ** 2 for p in sequences[k]), k))
        for i, k in enumerate(own):
            turn, at = divmod(i, n)
            out[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, tiers: tuple[int, ...] = TIERS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step (and ids)."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers, reverse=True):
        raise ValueError("tiers are powers of two, the longest first")
    rows = docs.select(docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step"]
    ddl = ", ".join([field_ddl(rows, "id", id_col), *(f"{n} bigint" for n in names)] + ["ids array<int>"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = WordBpe(vocabulary), array.array("I", [end_id]).tobytes()
        bpe, end = WordBpe(vocabulary), array.array("I", [end_id]).tobytes()
        base, keys, held, tokens, kind = TaskContext.get().partitionId() << 36, [], [], 0, None
        made, stepped, left = 0, 0, []

        def flush(last: bool):
            nonlocal made, stepped, left, keys, held, tokens
            sequences, left = pack_group([len(x) // 4 for x in held], tiers, left, last)
            of, cols = steps(sequences), [[] for _ in names]
            who, ids = [], []
            for k, pieces in enumerate(sequences):
                offset, size = 0, sum(p[2] for p in pieces)
                for doc, start, length in pieces:
                    part = held[doc][4 * start : 4 * (start + length)]
                    who.append(keys[doc])
                    for col, x in zip(cols, (start, length, zlib.crc32(part), len(held[doc]) // 4, base + made + k, offset, size, base + stepped + of[k])):
                        col.append(x)
                    if with_ids:
                        ids.append(array.array("I", part).tolist())
                    offset += length
            made, stepped = made + len(sequences), stepped + max(of, default=-1) + 1
            for at in range(0, len(who), 20_000):
                part = slice(at, at + 20_000)
                arrays = [pa.array(who[part], kind), *(pa.array(c[part], pa.int64()) for c in cols)] + [pa.array(ids[part], pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, *names] + ["ids"] * with_ids)
            stay = sorted({doc for doc, _, _ in left})
            left = [(stay.index(doc), start, length) for doc, start, length in left]
            keys, held, tokens = [keys[doc] for doc in stay], [held[doc] for doc in stay], 0

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, own in zip(batch.column(0).to_pylist(), bpe.ids(batch.column(1))):
                keys.append(key)
                held.append(own + end)
                tokens += len(own) // 4 + 1
                if tokens >= GROUP_TOKENS or len(held) >= GROUP_DOCS:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(run, ddl)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
