"""Texts cut into units that a tokenizer never joins, so that each different unit is encoded once.

A unit begins at a space or line feed that follows a character known to be no
white space, and runs to the next such place. The byte-level pre-tokenizer
starts a token there, and the piece vocabulary has no piece that holds a line
feed or goes on with a space after anything else, so the tokens of a text are
those of its units in a row. Both facts are checked on the files when they are
loaded. What a worker remembers is bounded in units and in bytes.
"""

from __future__ import annotations

import json
import os

import numpy as np

from plumbline.llm.words import Texts, Words, hash_words

#: Longest unit a worker remembers between slices, in bytes.
LONGEST = 64
#: Bytes of units encoded as one string, and units looked up at once.
BLOCK, LOOKED = 1 << 16, 1 << 19

_BREAK = np.zeros(256, bool)
_BREAK[[0x20, 0x0A]] = True
_ASCII = np.zeros(256, bool)
_ASCII[0x21:0x7F] = True
# First bytes of characters that are never white space: U+00C0-U+07FF, U+4000-U+DFFF, beyond U+FFFF.
_LEAD = {2: (0xC3, 0xDF), 3: (0xE4, 0xED), 4: (0xF0, 0xF4)}


def _solid_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is known to be no white space."""
    good = _ASCII[data[at - 1]]
    tail = (data[at - 1] & 0xC0) == 0x80
    for width, (low, high) in _LEAD.items():
        room = at >= width
        lead = data[np.where(room, at - width, 0)]
        good |= tail & room & (lead >= low) & (lead <= high)
        tail &= (data[np.where(room, at - width, 0)] & 0xC0) == 0x80
    return good


def find_units(texts: Texts) -> Words:
    """The units of each text, in a row and without gaps; an empty text has none."""
    at = np.flatnonzero(_BREAK[texts.data])
    at = at[at > 0]
    at = at[_solid_before(texts.data, at)]
    mark = np.zeros(len(texts.data), bool)
    mark[at] = mark[texts.offsets[:-1][np.diff(texts.offsets) > 0]] = True
    begins = np.flatnonzero(mark)
    ends = np.append(begins[1:], len(texts.data)) if len(begins) else begins
    return Words(begins, ends, np.searchsorted(begins, texts.offsets))


def _same_bytes(data: np.ndarray, units: Words, other: np.ndarray) -> np.ndarray:
    """Whether each unit has the bytes of the unit named for it."""
    size = units.end - units.start
    same = size == size[other]
    size = np.where(same, size, 0)
    run = np.concatenate(([0], np.cumsum(size)))
    step = np.arange(run[-1])
    differ = data[step + np.repeat(units.start - run[:-1], size)] != data[step + np.repeat(units.start[other] - run[:-1], size)]
    wrong = np.concatenate(([0], np.cumsum(differ)))
    return same & (wrong[run[1:]] == wrong[run[:-1]])


class Memory:
    """Numbers for different units; what is known of a unit is kept in lists by its number."""

    #: Units remembered between slices.
    remembered = 250_000

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.known: list[list] = []

    def learn(self, new: list[bytes]) -> None:
        """Append to the lists what is to be known of new units."""
        raise NotImplementedError

    def _numbers(self, names: list[bytes]) -> list[int]:
        """The numbers of different units. New ones are remembered while there is room and no other has been let go."""
        got = list(map(self.number.get, names))
        missing = [i for i, g in enumerate(got) if g is None]
        if missing:
            first = len(self.known[0])
            missing.sort(key=lambda i: len(names[i]) > LONGEST)
            new = [names[i] for i in missing]
            self.learn(new)
            if first == len(self.number):
                room = min(self.remembered - first, sum([len(n) <= LONGEST for n in new]))
                self.number.update(zip(new[:room], range(first, first + room)))
            for k, i in enumerate(missing, first):
                got[i] = k
        return got

    def look_up(self, texts: Texts, units: Words, lead: bytes = b"") -> np.ndarray:
        """The number of each unit; ``lead`` goes before the first unit of a text.

        Equal units are told by a hash, held against the bytes, and looked up once.
        """
        raw, out = texts.data.tobytes(), np.empty(len(units.start), np.uint32)
        for low in range(0, len(out), LOOKED):
            part = Words(units.start[low:low + LOOKED], units.end[low:low + LOOKED], np.zeros(1, np.int64))
            _, at, back = np.unique(hash_words(texts, part), return_index=True, return_inverse=True)
            same = _same_bytes(texts.data, part, at[back])
            numbers = self._numbers([raw[s:e] for s, e in zip(part.start[at].tolist(), part.end[at].tolist())])
            out[low:low + LOOKED] = np.array(numbers, np.uint32)[back]
            for i in np.flatnonzero(~same).tolist():
                out[low + i] = self._numbers([raw[part.start[i]:part.end[i]]])[0]
        if lead:
            first = units.first[:-1][units.count > 0]
            names = [lead + raw[s:e] for s, e in zip(units.start[first].tolist(), units.end[first].tolist())]
            known = list(dict.fromkeys(names))
            own = dict(zip(known, self._numbers(known)))
            out[first] = [own[n] for n in names]
        return out

    def forget(self) -> None:
        """Let go what is not remembered; its numbers are void then."""
        for held in self.known:
            del held[len(self.number):]


class Packed(Memory):
    """Ids of units as packed numbers, put together for whole texts."""

    type: np.dtype
    find = staticmethod(find_units)

    def __init__(self):
        super().__init__()
        self.packed: list[bytes] = []
        self.known = [self.packed]

    def encode(self, texts: Texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by ``end_id`` if given, and their number in each text."""
        units = self.find(texts)
        numbers = self.look_up(texts, units)
        place = np.zeros(len(self.packed) + 1, np.int64)
        place[numbers] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        order, packed, counts = place[numbers], [self.packed[i] for i in used.tolist()], units.count
        if end_id is not None:
            order, counts = np.insert(order, units.first[1:], len(packed)), counts + 1
            packed.append(np.array([end_id], self.type).tobytes())
        self.forget()
        ids = np.frombuffer(b"".join(packed), self.type)
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.type.itemsize
        begins, each = (np.cumsum(sizes) - sizes)[order], sizes[order]
        run = np.concatenate(([0], np.cumsum(each)))
        stop = np.cumsum(counts)
        return ids[np.repeat(begins - run[:-1], each) + np.arange(run[-1])], run[stop] - run[stop - counts]


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ends_solid(unit: bytes) -> bool:
    if 0x21 <= unit[-1] <= 0x7E:
        return True
    last = unit[-4:].decode(errors="ignore")[-1:]
    return not last.isspace() and last != "▁"


class ByteTokens:
    """A byte-level BPE of the tokenizers library, applied to lists of units."""

    def __init__(self, path: str, special_as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = json.loads(self.library.to_str())
        before = steps["pre_tokenizer"] or {}
        if steps["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or any(
                t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in steps["added_tokens"]):
            raise ValueError(f"{path} may join what stands on both sides of a space")
        self.library.encode_special_tokens = special_as_text
        by_byte = _byte_letters()
        names = self.library.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.bytes[i] = bytes(by_byte[c] for c in name) if all(c in by_byte for c in name) else name.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


class PieceTokens:
    """A piece model of the sentencepiece library, which puts a space before a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.library.get_piece_size()):
            name = self.library.id_to_piece(i)
            plain = name.replace("▁", " ")
            if "\n" in name or " " in plain.lstrip(" "):
                raise ValueError(f"{path} may join what stands on both sides of a space")
            held = bytes([int(name[3:5], 16)]) if self.library.is_byte(i) else plain.encode()
            self.bytes.append(b"" if self.library.is_control(i) or self.library.is_unknown(i) else held)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts that begin with a space, which is the one the library adds."""
        return [np.array(ids, np.int64) for ids in self.library.encode([t[1:] for t in texts], num_threads=1)]


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def blocks(units: list[bytes]) -> list[list[int]]:
    """Places of units that may be encoded as one string: each but the last of a block ends in no white space, and begins with a break."""
    out, held, size = [], [], 0
    for i, unit in enumerate(units):
        if unit[:1] not in (b" ", b"\n"):
            out.append([i])
            continue
        held.append(i)
        size += len(unit)
        if size >= BLOCK or not ends_solid(unit):
            out.append(held)
            held, size = [], 0
    return out + [held] * bool(held)
