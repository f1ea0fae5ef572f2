"""Encoding and decoding with merge-type sentencepiece vocabularies.

A text is normalised (a word border in front, spaces become word borders) and merged from single
characters upwards: an agenda holds every adjacent pair of symbols whose joint text is a piece, ordered by the
piece's score and then from left to right. The best pair is taken and merged unless one of its symbols is no
longer there, and the pairs with its new neighbours enter the agenda. Characters without a piece
become the pieces of their UTF-8 bytes.

No merge crosses two characters that stand side by side in no piece of the vocabulary. If the vocabulary allows it, a text is
cut at its word borders, so that a worker may remember the ids of ``REMEMBERED`` words. The agendas of all new words of some
texts are one array, from which every word takes its best pair at the same time. Longer stretches have a heap each and are cut
wherever no piece joins two neighbours; one without such a cut takes some 300 bytes of memory a character.

Batches arrive and leave as Arrow record batches, and every batch is compared with the sentencepiece library: ``agrees``
says whether ids and decoded text of a row are the library's.
"""

from __future__ import annotations

import re
import sys
from array import array
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sellerlens.llm.shared import by_batches

MODEL = "piece_bpe_32k.model"
BORDER = "▁"
REMEMBERED = 1_000_000     # words whose ids a worker keeps
REMEMBERED_CHARS = 64    # of words up to this length
SECTION = 1_000_000      # characters the library encodes at a time when results are compared
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
PLACE = 32               # bits of an agenda entry that hold a symbol's place
LOW = (1 << PLACE) - 1
SHORT = 48               # characters up to which a stretch's agenda is a list, or a part of the common array
TOGETHER = 4_000_000     # characters of texts that are encoded together
NEVER = 1 << 31          # rank of a pair that is no piece
NOTHING = 1 << 62        # entry of such a pair


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model_file

        with open(path, "rb") as f:
            model = model_file.ModelProto.FromString(f.read())
        kinds = {p.type for p in model.pieces}
        if model.trainer_spec.model_type != model_file.TrainerSpec.BPE:
            raise ValueError("not a vocabulary of merges")
        if not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only vocabularies with byte fallback and without unused or user-defined pieces")
        spec = model.normalizer_spec
        plain = (
            not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces
            and not spec.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        )
        if not plain:
            raise ValueError("only vocabularies that put one word border in front and keep all white space")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.end = self.library.eos_id()

        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        place = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in score.items() if len(p) > 1}  # equal scores share a rank
        self.beside = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.words_apart = not any(pair[0] != BORDER and pair[1] == BORDER for pair in self.beside)
        self.known: dict[str, bytes] = {}  # ids of a word border and this word
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # ids of parts of long stretches
        self.whole = {p: array("i", [i]).tobytes() for p, i in self.id.items() if len(p) == 1}
        self._pairs()

        self.shown = [p.piece.replace(BORDER, " ") for p in model.pieces]
        self.bordered = [p.type == NORMAL and p.piece.startswith(BORDER) for p in model.pieces]
        self.silent = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        for i, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.shown[i] = chr(0xDC00 + int(p.piece[3:5], 16))
            elif p.type in (CONTROL, UNKNOWN):
                self.shown[i] = "\ud800" if p.type == CONTROL else model.trainer_spec.unk_surface
        # Pieces that say the same wherever they stand; an ASCII byte is part of no longer sequence.
        ascii_ids = {i: chr(b) for b, i in self.byte.items() if b < 128}
        self.odd = np.array([p.type != NORMAL and i not in ascii_ids for i, p in enumerate(model.pieces)])
        self.plain = pa.array(["" if self.odd[i] else ascii_ids.get(i, s) for i, s in enumerate(self.shown)], pa.string())
        self.bordered_ids = np.array(self.bordered)

    # --- encoding ---

    def merged(self, word: str) -> list[str]:
        """Symbols of a stretch of normalised text, by an agenda of adjacent pairs.

        An entry is the rank of the pair's piece with the place of its left symbol in the low bits. The agenda of a
        short word is a list of ranks by place, which costs less to search than a heap costs to keep.
        """
        symbols, n, rank = list(word), len(word), self.rank
        if n <= SHORT:
            agenda = [rank.get(word[i : i + 2], NEVER) for i in range(n - 1)]
            while agenda and (best := min(agenda)) < NEVER:
                i = agenda.index(best)
                symbols[i] = piece = symbols[i] + symbols[i + 1]
                del symbols[i + 1], agenda[i]
                if i < len(agenda):
                    agenda[i] = rank.get(piece + symbols[i + 1], NEVER)
                if i:
                    agenda[i - 1] = rank.get(symbols[i - 1] + piece, NEVER)
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [rank[word[i : i + 2]] << PLACE | i for i in range(n - 1) if word[i : i + 2] in rank]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & LOW
            j = after[i]
            if not symbols[i] or j >= n:
                continue
            piece = symbols[i] + symbols[j]
            if rank.get(piece) != entry >> PLACE:
                continue  # one of the two has gone into another symbol
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = rank.get(piece + symbols[k])
                if found is not None:
                    heappush(agenda, found << PLACE | i)
            h = before[i]
            if h >= 0:
                found = rank.get(symbols[h] + piece)
                if found is not None:
                    heappush(agenda, found << PLACE | h)
        return [s for s in symbols if s]

    def _ids(self, stretch: str) -> bytes:
        if stretch in self.whole:
            return self.whole[stretch]
        ids = array("i")
        for s in self.merged(stretch):
            if s in self.id:
                ids.append(self.id[s])
            else:
                ids.extend(self.byte[b] for b in s.encode())
        return ids.tobytes()

    def _pairs(self) -> None:
        """Symbols by number, and every pair of symbols that makes a piece as a sorted key with rank and joint symbol."""
        symbols = list(self.id) + sorted({c for p in self.rank for c in p} - self.id.keys())
        number = {s: n for n, s in enumerate(symbols)}
        self.symbol_id = np.array([self.id.get(s, -1) for s in symbols], np.int32)
        self.symbol = np.full(sys.maxunicode + 1, -1, np.int64)  # of a character
        for s in symbols:
            if len(s) == 1:
                self.symbol[ord(s)] = number[s]
        self.n_symbols = len(symbols)
        made = sorted(
            (number[p[:i]] * self.n_symbols + number[p[i:]], r, number[p])
            for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in number and p[i:] in number
        )
        made.append((self.n_symbols**2, 0, 0))  # stands behind every pair
        self.pair_key, self.pair_rank, self.pair_symbol = (np.array(c, np.int64) for c in zip(*made, strict=True))

    def _found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the pairs that make a piece, -1 for none."""
        key = np.where((left >= 0) & (right >= 0), left * self.n_symbols + right, -1)
        place = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[place] == key, place, -1)

    def merged_words(self, words: list[str]) -> list[bytes]:
        """Ids of stretches of up to ``SHORT`` characters, by one agenda for all of them.

        An entry is the rank of a pair's piece with the place of its left symbol in the low bits, so that the least
        entry of a stretch is its best and leftmost pair. Every round merges one pair of each stretch that has one.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(chars)
        symbols = np.append(self.symbol[chars], -1)  # the last one stands for "no symbol"
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        before[begin], after[begin + sizes - 1] = n, n
        pair = np.append(self._found(symbols[:n], symbols[after[:n]]), -1)
        place = np.arange(n + 1)
        agenda = np.where(pair >= 0, self.pair_rank[pair] << PLACE | place, NOTHING)
        there = np.ones(n + 1, bool)
        starts, ends = begin, begin + sizes
        own = agenda[:n]  # what the stretches still open hold of the agenda
        at = place[:n]
        while len(at):
            best = np.minimum.reduceat(own, starts)
            busy = best < NOTHING
            i = best[busy] & LOW
            if not len(i):
                break
            j = after[i]
            symbols[i] = self.pair_symbol[pair[i]]
            k = after[i] = after[j]
            before[k] = i
            h = before[i]
            there[j], agenda[j] = False, NOTHING
            for left, right in ((i, k), (h, i)):
                pair[left] = found = self._found(symbols[left], symbols[right])
                agenda[left] = np.where(found >= 0, self.pair_rank[found] << PLACE | left, NOTHING)
            symbols[n], agenda[n] = -1, NOTHING
            lengths = (ends - starts)[busy]
            if 2 * busy.sum() < len(busy):  # closed stretches leave
                at = at[np.repeat(busy, ends - starts)]
                ends = np.cumsum(lengths)
                starts = ends - lengths
            own = agenda[at]
        symbols, there = symbols[:n], there[:n]
        ids = np.where(symbols >= 0, self.symbol_id[symbols], -1)[there].astype(np.int32)
        ends = np.cumsum(np.add.reduceat(there, begin)) * 4
        data, out, last = ids.tobytes(), [], 0
        for end in ends.tolist():
            out.append(data[last:end])
            last = end
        for w in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0) * 4, side="right")).tolist():
            where, found = np.flatnonzero(there[begin[w] : begin[w] + sizes[w]]), array("i")
            for c, x in zip(where.tolist(), np.frombuffer(out[w], np.int32).tolist(), strict=True):
                found.extend([x] if x >= 0 else [self.byte[b] for b in words[w][c].encode()])
            out[w] = found.tobytes()
        return out

    def _long(self, stretch: str) -> bytes:
        """Ids of a stretch, cut where no piece joins two neighbours; short parts are remembered."""
        beside, parts = self.beside, self.parts
        cuts = [i + 1 for i in range(len(stretch) - 1) if stretch[i : i + 2] not in beside]
        found = []
        for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True):
            part = stretch[a:b]
            ids = parts.get(part)
            if ids is None:
                ids = self._ids(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(parts) >= REMEMBERED // 4:
                        parts.clear()
                    parts[part] = ids
            found.append(ids)
        return b"".join(found)

    def words(self, text: str) -> list[str]:
        """Normalised text in stretches that begin with word borders, without the first of each."""
        if not (BORDER in text or "  " in text or text[:1] == " " or text[-1:] == " "):
            return text.split(" ")
        return [run[1:] for run in _RUNS.findall(BORDER + text.replace(" ", BORDER))]

    def _learn(self, words: set[str]) -> list[str]:
        """Make ``words`` known; those that are too long to be remembered come back, to be forgotten after use.

        Words of the last two generations are remembered; one that is met again passes on to the new one.
        """
        known, older = self.known, self.older
        words = [w for w in words if w not in known]
        known.update((w, older[w]) for w in words if w in older)
        words = [w for w in words if w not in known]
        short = [w for w in words if len(w) < SHORT]
        if short:
            known.update(zip(short, self.merged_words([BORDER + w for w in short]), strict=True))
        known.update((w, self._long(BORDER + w)) for w in words if len(w) >= SHORT)
        return [w for w in words if len(w) > REMEMBERED_CHARS]

    def _together(self, texts: list[str]) -> list[bytes]:
        if not self.words_apart:
            return [self._long(BORDER + t.replace(" ", BORDER)) if t else b"" for t in texts]
        words = [self.words(t) if t else [] for t in texts]
        forget = self._learn(set().union(*words))
        known = self.known
        ids = [b"".join([known[w] for w in of]) for of in words]
        for w in forget:
            del known[w]
        if 2 * len(known) >= REMEMBERED:
            self.known, self.older = {}, known if len(known) <= REMEMBERED else {}
        return ids

    def encode_all(self, texts: list[str | None], end: bool = True) -> list[np.ndarray]:
        """Ids of texts as int32; null is taken as empty, and an empty text has no ids but the end id."""
        out, some, size, last = [], [], 0, np.array([self.end] if end else [], np.int32).tobytes()
        for n, text in enumerate(texts, 1):
            some.append(text or "")
            size += len(some[-1])
            if size >= TOGETHER or n == len(texts):
                out += [np.frombuffer(ids + last, np.int32) for ids in self._together(some)]
                some, size = [], 0
        return out

    def encode(self, text: str | None, end: bool = True) -> np.ndarray:
        return self.encode_all([text], end)[0]

    # --- decoding ---

    def decode(self, ids) -> str:
        """The text of any ids: control ids say nothing, a first word border isn't shown, and bytes that aren't UTF-8 become U+FFFD."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        while ids and ids[-1] in self.silent:
            ids.pop()
        while ids and ids[0] in self.silent:
            ids.pop(0)
        text = "".join([self.shown[i] for i in ids])
        if ids and self.bordered[ids[0]]:
            text = text[1:]
        return _MARKED.sub(_unmarked, text)

    def decode_all(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of a batch, by one look-up for all ids; rows with ids that depend on their neighbours go through ``decode``."""
        if not len(flat):
            return pa.array([""] * (len(offsets) - 1), pa.string())
        first, last = offsets[:-1], offsets[1:]
        taken = self.plain.take(pa.array(flat))
        texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), taken), "")
        some = last > first
        bordered = some & self.bordered_ids[flat[np.minimum(first, len(flat) - 1)]]
        texts = pc.if_else(pa.array(bordered), pc.utf8_slice_codeunits(texts, 1), texts)
        odd = self.odd[flat]
        ends = last[some] - 1
        odd[ends] &= flat[ends] != self.end
        rows = np.unique(np.searchsorted(last, np.flatnonzero(odd), side="right"))
        if not len(rows):
            return texts
        texts = texts.to_pylist()
        for r in rows.tolist():
            texts[r] = self.decode(flat[first[r] : last[r]])
        return pa.array(texts, pa.string())

    # --- the library ---

    def library_ids(self, text: str | None, end: bool = True) -> list[int]:
        """The library's ids; a text of more than ``SECTION`` characters is handed over in sections that end with a word."""
        text, ids, at = text or "", [], 0
        while len(text) - at > 2 * SECTION and self.words_apart:
            cut = text.find(" ", at + SECTION)
            while 0 <= cut and text[cut - 1] in (" ", BORDER):
                cut = text.find(" ", cut + 1)
            if cut < 0 or cut >= len(text) - 1:
                break
            ids += self.library.encode(text[at:cut])
            at = cut + 1
        ids += self.library.encode(text[at:])
        return [*ids, self.end] if end else ids


# What text can't contain: held-back bytes as U+DC00 and up, control pieces as U+D800.
_MARKED = re.compile("[\udc00-\udcff]+|\ud800")
_RUNS = re.compile(f"{BORDER}+[^{BORDER}]*|[^{BORDER}]+")


def _unmarked(run: re.Match) -> str:
    if run[0] == "\ud800":
        return ""
    data, out, at = bytes(ord(c) - 0xDC00 for c in run[0]), [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


@cache
def pieces(path: str) -> Pieces:
    """One per Python worker; the words it remembers last as long as the worker."""
    return Pieces(path)


def _round_trip(path: str, end: bool, check: bool):
    def run(batches):
        model = pieces(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            ids = model.encode_all(texts, end)
            offsets = np.cumsum([0, *[len(i) for i in ids]]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            decoded = model.decode_all(flat, offsets)
            agrees = [
                i.tolist() == (theirs := model.library_ids(t, end)) and d == model.library.decode(theirs)
                for t, i, d in zip(texts, ids, decoded.to_pylist(), strict=True)
            ] if check else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded, pa.array(agrees, pa.bool_())],
                names=["id", "ids", "decoded", "agrees"],
            )

    return run


def round_trip(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str | None = None, end: bool = True, check: bool = True
) -> DataFrame:
    """``<id_column>, ids, decoded, agrees``: every whole text's ids, and the text decoded from these ids.

    ``model`` is a model file every worker can read. ``end`` puts the end id behind each text. With ``check`` the library
    encodes and decodes each text as well; without it ``agrees`` is null. A null text is taken as empty; an empty text
    has no ids but the end id and decodes to an empty text. Null or repeated ids give rows like any other.
    An empty table gives no rows, and other columns aren't looked at.
    """
    by_batches(docs.sparkSession)
    key = docs.schema[id_column].dataType.simpleString()
    narrow = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    found = narrow.mapInArrow(_round_trip(model or model_path(), end, check), f"id {key}, ids array<int>, decoded string, agrees boolean")
    return found.withColumnRenamed("id", id_column)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``<id_column>, n_tokens, ids_sha256, decoded_sha256, agrees`` of the rows of ``round_trip``."""
    return found.select(
        id_column, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees",
    )
