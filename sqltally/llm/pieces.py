"""SentencePiece encoding and decoding for merge-type vocabularies, checked against the library.

Encoding starts from single characters.  An agenda holds the neighbouring pairs whose joined text is a
piece, best score first and leftmost among equals; the best one whose symbols still stand is merged and
its new pairs are added.  What is no piece in the end becomes byte pieces (or the unknown id).

No merge crosses a place where no piece of the vocabulary fits, so texts are cut there (before
white space, and around characters that are in no longer piece) and the ids of a cut part are
remembered.  Whether a cut is safe is read from the vocabulary itself.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Parts remembered by a worker, and the longest remembered part; others are encoded again.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 48
#: Parts of up to so many characters keep their agenda as a flat list, longer ones as a heap.
FLAT = 24
#: Bytes of text encoded, and compared with the library, at a time.
TOGETHER = 1 << 20


def _one_by_one(error: UnicodeDecodeError) -> tuple[str, int]:
    """Each byte that is no part of a character becomes U+FFFD."""
    return "�", error.start + 1


codecs.register_error("pieces_one_by_one", _one_by_one)


class Vocabulary(dict):
    """Ids of the parts of a text met so far; a missing part is encoded by the agenda."""

    def __init__(self, model: str):
        super().__init__()
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        kind, norm = proto.SentencePiece, proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE:
            raise ValueError("the vocabulary is not of the merge type")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only vocabularies that leave texts as they are, but for the space sign, can be used")
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("vocabularies with user-defined or unused pieces cannot be used")
        self.prefix = norm.add_dummy_prefix
        self.end = self.library.eos_id()
        self.unknown = self.library.unk_id()
        self.unknown_text = proto.trainer_spec.unk_surface
        self.known = {p.piece: n for n, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        places = {score: n for n, score in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
        self.merges = {p.piece: places[p.score] for p in proto.pieces if p.type == kind.NORMAL and len(p.piece) > 1}
        self.before: dict[str, tuple[int, ...]] = {}
        #: parts encoded since the last check, and those on which the library differs
        self.fresh: list[tuple[str, tuple[int, ...]]] = []
        self.wrong: set[str] = set()
        self.bytes = {int(p.piece[3:-1], 16): n for n, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_of = {n: b for b, n in self.bytes.items()}
        self.high = frozenset(n for n, b in self.byte_of.items() if b > 127)
        self.texts = [p.piece.replace(SPACE, " ") if p.type == kind.NORMAL else "" for p in proto.pieces]
        for n, b in self.byte_of.items():
            self.texts[n] = chr(b) if b < 128 else ""  # a byte below 128 is a character by itself
        self.texts[self.unknown] = self.unknown_text
        self.decimal = [str(n) for n in range(len(self.texts))]
        self.parts = re.compile(self._cuts(list(self.merges)))
        #: texts can be cut by splitting them at blanks and line ends
        self.simple = self.parts.pattern == f"{SPACE}+[^{SPACE}\n\t]*|[^{SPACE}\n\t]+|[\n\t]"

    @staticmethod
    def _cuts(longer: list[str]) -> str:
        """Pattern of parts between which no piece of several characters reaches."""
        inside = set(chain.from_iterable(longer))
        alone = "".join(c for c in "\n\t" if c not in inside)
        if any(SPACE in p.lstrip(SPACE) for p in longer):
            return f"[{alone}]|[^{alone}]+" if alone else r"(?s:.+)"
        return f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else "")

    def __missing__(self, part: str) -> tuple[int, ...]:
        found = self.before.get(part)
        if found is None:
            symbols = self._flat(part) if len(part) <= FLAT else self._heap(part)
            found = tuple(map(self.known.get, symbols))
            if None in found:
                found = tuple(chain.from_iterable(map(self._ids, symbols)))
            self.fresh.append((part, found))
        if len(part) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:  # parts not met since the last time are forgotten
                self.before = dict(self)
                self.clear()
            self[part] = found
        return found

    def _flat(self, part: str) -> list[str]:
        """Symbols of a short part; the agenda has one place per pair, the first of the best is next."""
        never = len(self.texts) + 1
        place = self.merges.get
        symbols = list(part)
        agenda = [place(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols[i + 1]
            del symbols[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = place(joined + symbols[i + 1], never)
            if i:
                agenda[i - 1] = place(symbols[i - 1] + joined, never)
        return symbols

    def _heap(self, part: str) -> list[str]:
        """Symbols of a part of any length."""
        merges, symbol, size = self.merges, list(part), len(part)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        pairs = ((i, part[i : i + 2]) for i in range(size - 1))
        agenda = [(merges[joined], i, i + 1, joined) for i, joined in pairs if joined in merges]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, joined = heapq.heappop(agenda)
            # symbols only grow, so a pair still stands if its joined text is still that of both
            if not symbol[i] or after[i] != j or symbol[i] + symbol[j] != joined:
                continue
            symbol[i], symbol[j] = joined, ""
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                new = joined + symbol[k]
                if new in merges:
                    heapq.heappush(agenda, (merges[new], i, k, new))
            h = before[i]
            if h >= 0:
                new = symbol[h] + joined
                if new in merges:
                    heapq.heappush(agenda, (merges[new], h, i, new))
        return [s for s in symbol if s]

    def _ids(self, symbol: str) -> tuple[int, ...]:
        if symbol in self.known:
            return (self.known[symbol],)
        if self.bytes:
            return tuple(self.bytes[b] for b in symbol.encode())
        return (self.unknown,)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` and the end id."""
        ids = list(chain.from_iterable(map(self.__getitem__, self.cut(text))))
        ids.append(self.end)
        return ids

    def cut(self, text: str) -> list[str]:
        """Parts of ``text`` with the space sign, which encode independently."""
        start = SPACE if self.prefix and text else ""
        if self.simple and "  " not in text and SPACE not in text and text[:1] != " ":
            # every blank begins a part and a line end is one; what lies between them may be empty
            return (start + text.replace(" ", " " + SPACE)).replace("\n", " \n ").split(" ")
        return self.parts.findall(start + text.replace(" ", SPACE))

    def agrees(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library encodes ``texts`` the same.

        Where texts are cut at blanks and line ends the library is asked about every part when it is first met, all
        new parts as one text with a line end before each; else about every whole text.
        """
        if not self.simple:
            self.fresh.clear()
            return [i == j for i, j in zip(ids, self.library.encode(texts, add_eos=True, num_threads=1))]
        new, self.fresh = [f for f in self.fresh if f[0]], []
        if not self._confirmed(new):
            self.wrong |= {part for part, found in new if not self._confirmed([(part, found)])}
        if not self.wrong:
            return [True] * len(texts)
        return [self.wrong.isdisjoint(self.cut(t)) for t in texts]

    def _confirmed(self, parts: list[tuple[str, tuple[int, ...]]]) -> bool:
        end = self.encode("\n")[:-1]
        line = self["\n"]
        want = end[: len(end) - len(line)]
        for _, found in parts:
            want += line
            want += found
        return self.library.encode("".join(["\n" + part for part, _ in parts]).replace(SPACE, " "), num_threads=1) == want if parts else True

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``: control ids have none, byte pieces in a row are read as UTF-8."""
        if self.high.isdisjoint(ids):
            text = "".join(map(self.texts.__getitem__, ids))
        else:
            made, octets = [], bytearray()
            for n in ids:
                if n in self.byte_of:
                    octets.append(self.byte_of[n])
                    continue
                if octets:
                    made.append(octets.decode("utf-8", "pieces_one_by_one"))
                    octets.clear()
                made.append(self.texts[n])
            made.append(octets.decode("utf-8", "pieces_one_by_one"))
            text = "".join(made)
        shown = next((n for n in ids if n in self.byte_of or self.texts[n]), None)
        starts = shown is not None and shown not in self.byte_of and shown != self.unknown
        return text[1:] if self.prefix and starts and text.startswith(" ") else text


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` of about ``TOGETHER`` bytes of its second column; a longer text is a part alone."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = sizes[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(sizes, before + TOGETHER, "right")))
        yield batch.slice(first, stop - first)
        first = stop


@cache
def vocabulary(model: str) -> Vocabulary:
    """One per worker."""
    return Vocabulary(model)


def encode_pieces(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded, agrees): ids with an end id, and their text, of every row of ``docs``.

    ``agrees`` tells whether the sentencepiece library gives the same ids and the same text.  It is asked
    once per slice of an Arrow batch: about the ids of all parts first met there (see ``Vocabulary.agrees``) and the
    text of every list of ids.  A null text counts as empty and has the end id
    only.  Repeated rows come out as often as they occur; other columns are left out.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for b in chain.from_iterable(map(slices, batches)):
            texts = b.column(1).to_pylist()
            ids = [known.encode(t) for t in texts]
            decoded = [known.decode(i) for i in ids]
            same = [a and d == e for a, d, e in zip(known.agrees(texts, ids), decoded, known.library.decode(ids, num_threads=1))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "ids", "decoded", "agrees"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(encoded, f"doc_id {kind}, ids array<int>, decoded string, agrees boolean")
