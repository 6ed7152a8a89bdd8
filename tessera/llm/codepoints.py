"""Text as numpy code-point arrays: decoding, folding by lookup tables, composition.

A *fold* sends each code point to zero or more code points through one gather
(``data[start[c] + k]``), so that a batch of texts is folded without a call per
text.  Combining marks are then ordered and composed for all texts at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

SIZE = 0x110000

# Characters of one class, by appearance.
HYPHENS = "-\u2010\u2011\u2012\u2043\u2212\ufe63\uff0d"
MIDDLE_DOTS = "\u00b7\u0387\u2027\u2219\u22c5\u30fb\uff65\u318d\u119e\u2e31\ua78f"
WHITE = "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85\u2028\u2029"
#: Ranges of characters that show nothing, beside the format characters (category Cf).
UNSEEN = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164),
          (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF))

# Letters of other scripts and the letter of the same shape, pairwise.
SAME_SHAPE = {
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳϹ": "ABEZHIKMNOPTYXovcjC",
    "АВЕКМНОРСТУХЅІЈԚԜҮ": "ABEKMHOPCTYXSIJQWY",
    "аеорсухѕіјһԁԛԝү": "aeopcyxsijhdqwy",
    "ՕՏՍօոսհց": "OSUonuhg",
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ": "ABCDEHJKLMPRSTVWZ",
    "ニロハカエトタヘベペㅡー": "二口八力工卜夕へべぺ一一",
}


def _single_shapes() -> dict[str, str]:
    return {a: b for other, own in SAME_SHAPE.items() for a, b in zip(other, own, strict=True)}


class Fold:
    """A fold table: start and count index ``data``, by code point."""

    def __init__(self, images: dict[int, tuple[int, ...]]):
        self.start = np.arange(SIZE, dtype=np.int32)
        self.count = np.ones(SIZE, dtype=np.int8)
        data = [np.arange(SIZE, dtype=np.uint32)]
        more = []
        for c, image in images.items():
            if len(image) == 1:
                data[0][c] = image[0]
            else:
                self.start[c] = SIZE + len(more)
                self.count[c] = len(image)
                more.extend(image)
        self.data = np.concatenate([*data, np.array(more, dtype=np.uint32)])

    def __call__(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[chars]
        if (count == 1).all():
            return self.data[chars], offsets
        ends = np.cumsum(count, dtype=np.int64)
        source = np.repeat(np.arange(len(chars)), count)
        inner = np.arange(len(source)) - (ends - count)[source]
        out = self.data[self.start[chars][source] + inner]
        return out, np.concatenate([[0], ends])[offsets]


class Composer:
    """Canonical ordering and composition of marks and Hangul letters."""

    def __init__(self):
        self.rank = np.zeros(SIZE, dtype=np.uint8)
        pairs = {}
        for c in _assigned():
            ch = chr(c)
            if r := unicodedata.combining(ch):
                self.rank[c] = r
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and parts[0][0] != "<":
                a, b = (int(p, 16) for p in parts)
                if unicodedata.normalize("NFC", chr(a) + chr(b)) == ch:
                    pairs[a << 21 | b] = c
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys], dtype=np.uint32)
        jamo = np.zeros(SIZE, dtype=bool)
        jamo[0x1100:0x1200] = True
        self.special = (self.rank > 0) | jamo

    def __call__(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars, keep = self.composed(chars, offsets)
        return (chars, offsets) if keep is None else (chars[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])

    def composed(self, chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Characters in their places, and which of them stay (None: all)."""
        if not self.special[chars].any():
            return chars, None
        chars, keep = chars.copy(), np.ones(len(chars), dtype=bool)
        opens = np.zeros(len(chars) + 1, dtype=bool)
        opens[offsets] = True
        opens = opens[:-1]
        self._marks(chars, keep, opens)
        self._hangul(chars, keep, opens)
        return chars, keep

    def _marks(self, chars: np.ndarray, keep: np.ndarray, opens: np.ndarray) -> None:
        rank = self.rank[chars]
        if not rank.any():
            return
        head = (rank == 0) | opens
        group = np.cumsum(head)
        at = np.flatnonzero(head)
        length = np.diff(np.append(at, len(chars)))
        wrong = np.flatnonzero((rank[1:] < rank[:-1]) & ~head[1:] & (rank[:-1] > 0))
        if len(wrong):
            moved = np.flatnonzero(np.isin(group, group[wrong + 1]))
            chars[moved] = chars[moved[np.lexsort((rank[moved], group[moved]))]]
            rank = self.rank[chars]
        at, length = at[length > 1], length[length > 1]
        last = np.zeros(len(at), dtype=np.int64)
        step = 1
        while len(at):
            mark = at + step
            order = rank[mark].astype(np.int64)
            key = chars[at].astype(np.int64) << 21 | chars[mark]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            joined = (self.keys[place] == key) & (last < order) & (rank[at] == 0)
            chars[at[joined]] = self.values[place[joined]]
            keep[mark[joined]] = False
            last = np.where(joined, last, order)
            step += 1
            more = length > step
            at, length, last = at[more], length[more], last[more]

    @staticmethod
    def _hangul(chars: np.ndarray, keep: np.ndarray, opens: np.ndarray) -> None:
        def between(x, a, b):
            return (x >= a) & (x <= b)

        next_open = np.append(opens[1:], True)
        lead = np.flatnonzero(between(chars, 0x1100, 0x1112) & ~next_open)
        lead = lead[between(chars[lead + 1], 0x1161, 0x1175)]
        chars[lead] = 0xAC00 + ((chars[lead] - 0x1100) * 21 + (chars[lead + 1] - 0x1161)) * 28
        keep[lead + 1] = False
        tail = np.flatnonzero(between(chars, 0x11A8, 0x11C2) & keep & ~opens)
        base = np.where(keep[tail - 1], tail - 1, tail - 2) if len(tail) else tail
        fits = between(chars[base], 0xAC00, 0xD7A3) & ((chars[base] - 0xAC00) % 28 == 0)
        fits &= keep[base] & ((base == tail - 1) | ~opens[tail - 1])
        tail, base = tail[fits], base[fits]
        chars[base] += chars[tail] - 0x11A7
        keep[tail] = False


def _assigned():
    """Code points that may have a name of their own; ideographs and syllables fold to themselves."""
    yield from range(0x3400)
    yield from range(0xA000, 0xAC00)
    yield from range(0xF900, 0x20000)
    yield from range(0x2F800, 0x2FA20)
    yield from range(0xE0000, 0xE1000)


def _elementary(c: int, tags: tuple[str, ...]) -> tuple[int, ...]:
    """Full decomposition along canonical mappings and those compatibility mappings named."""
    parts = unicodedata.decomposition(chr(c)).split()
    if not parts:
        return (c,)
    if parts[0][0] == "<":
        same = c == 0xB5 or unicodedata.name(chr(c), "").startswith(("KANGXI RADICAL", "CJK RADICAL"))
        if parts[0] not in tags and not same:
            return (c,)
        parts = parts[1:]
    return tuple(x for p in parts for x in _elementary(int(p, 16), tags))


_CACHE: dict[str, object] = {}


def composer() -> Composer:
    if "composer" not in _CACHE:
        _CACHE["composer"] = Composer()
    return _CACHE["composer"]


def look_fold() -> Fold:
    """Fold to one representative of what a reader sees; case and visible marks stay."""
    if "look" not in _CACHE:
        shapes = {ord(a): ord(b) for a, b in _single_shapes().items()}
        for chars, one in ((HYPHENS, "-"), (MIDDLE_DOTS, "·"), (WHITE, " ")):
            shapes |= {ord(c): ord(one) for c in chars}
        images = {}
        for c in _assigned():
            if 0xD800 <= c < 0xE000:
                continue
            kind = unicodedata.category(chr(c))
            if kind == "Zs":
                image = (32,)
            elif c not in shapes and (kind in ("Cf", "Cc") or any(a <= c <= b for a, b in UNSEEN)):
                image = ()
            elif c in shapes:
                image = (shapes[c],)
            else:
                image = tuple(shapes.get(x, x) for x in _elementary(c, ("<wide>", "<narrow>", "<noBreak>")))
            if image != (c,):
                images[c] = image
        _CACHE["look"] = Fold(images)
    return _CACHE["look"]


def letter_folds():
    """For texts reduced to letters and digits.

    (fold of width and decomposition, lower case, mask of what stays, and for
    texts without marks: the whole image in one gather, the mask by original
    character, and the mask of characters that need the full way).
    """
    if "letters" not in _CACHE:
        images, lower = {}, np.arange(SIZE, dtype=np.uint32)
        keep = np.zeros(SIZE, dtype=bool)
        for c in range(0x30000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            kind = unicodedata.category(ch)
            keep[c] = kind[0] == "L" or kind == "Nd"
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
        special = composer().special.copy()
        narrow = np.arange(SIZE, dtype=np.uint32)
        for c in _assigned():
            if 0xD800 <= c < 0xE000:
                continue
            image = _elementary(c, ("<wide>", "<narrow>"))
            if unicodedata.category(chr(c)) in ("Cf", "Cc") or any(a <= c <= b for a, b in UNSEEN):
                image = ()
            if image == (c,):
                continue
            images[c] = image
            if len(image) == 1:
                narrow[c] = image[0]
            elif image and unicodedata.normalize("NFC", chr(c)) != chr(c):
                special[c] = True
        quick = lower[narrow]
        _CACHE["letters"] = (Fold(images), lower, keep, quick, keep[quick], special)
    return _CACHE["letters"]


def _flat(strings) -> pa.Array:
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if isinstance(strings, pa.ChunkedArray):  # combine_chunks of several large chunks
        strings = pa.concat_arrays(strings.chunks)
    return strings.fill_null("") if strings.null_count else strings


def decode(strings) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (nulls as empty) and the offsets of each text."""
    strings = _flat(strings)
    if not len(strings):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    _, ends, data = strings.buffers()
    at = np.frombuffer(ends, dtype=width)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    try:
        chars = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    except UnicodeDecodeError:  # bytes that are no text: replaced, text by text
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        return chars, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if len(chars) == len(raw):
        return chars, at
    first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return chars, first[at]


def encode(chars: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Arrow strings of the texts that ``offsets`` cut out of ``chars``."""
    data = chars.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (chars > 0x7F).astype(np.int8) + (chars > 0x7FF) + (chars > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[offsets]
    large = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return large.cast(pa.string())


def slices(strings, target_bytes: int = 1 << 20):
    """Row ranges of about ``target_bytes`` of text; a longer text stands alone, whole."""
    strings = _flat(strings)
    if not len(strings):
        return
    width = np.int64 if pa.types.is_large_string(strings.type) else np.int32
    at = np.frombuffer(strings.buffers()[1], dtype=width)[strings.offset : strings.offset + len(strings) + 1]
    row = 0
    while row < len(strings):
        stop = int(np.searchsorted(at, at[row] + target_bytes, side="right")) - 1
        stop = min(max(stop, row + 1), len(strings))
        yield row, stop
        row = stop


def look(strings) -> pa.Array:
    """Each text in the form in which equal-looking texts are equal; nulls stay null."""
    strings = strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings
    parts = []
    for a, b in slices(strings):
        parts.append(encode(*composer()(*look_fold()(*decode(strings[a:b])))))
    out = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
    return pa.compute.if_else(strings.is_valid(), out, pa.scalar(None, pa.string())) if strings.null_count else out


def letters_only(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case, width and composition undone."""
    _, _, _, quick, stay, special = letter_folds()
    out = quick[chars]
    stays = stay[chars]
    special = special[chars]
    if not special.any():
        return out[stays], np.concatenate([[0], np.cumsum(stays)])[offsets]
    # Texts with marks or Hangul letters go the full way; the others are composed already.
    ends = np.concatenate([[0], np.cumsum(stays)])[offsets]
    out = out[stays]
    hard = np.unique(np.searchsorted(offsets, np.flatnonzero(special), side="right") - 1)
    parts, length, done = [], np.diff(ends), 0
    for row in hard:
        whole, _ = _letters_full(chars[offsets[row] : offsets[row + 1]], offsets[row : row + 2] - offsets[row])
        parts += [out[ends[done] : ends[row]], whole]
        length[row], done = len(whole), row + 1
    parts.append(out[ends[done] :])
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(length)])


def _letters_full(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    fold, lower, keep, *_ = letter_folds()
    chars, offsets = composer()(*fold(chars, offsets))
    chars = lower[chars]
    stays = keep[chars]
    return chars[stays], np.concatenate([[0], np.cumsum(stays)])[offsets]
