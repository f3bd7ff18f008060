"""Baseline JPEG columns: payloads stored as quantized coefficients, headers parsed, scans decoded, thumbnails hashed.

A payload (bytes, a multiple of 64) becomes a grey baseline JPEG (SOF0, 8 bits, one component, quantization steps of
1): byte b is coefficient b - 128, 64 of them a block in zigzag order, so nothing is rounded and the payload comes
back exactly. Every block is a restart interval, which makes blocks independent.

The decoder reads any baseline JPEG: one or several components and scans, any sampling factors, restart interval and
tables, segments it has no use for skipped. It finds the markers, takes the stuffing out and then decodes one symbol of
every restart interval of every image of a slice at a time in numpy, by look-up in the tables that it read from the
files; differences of DC coefficients are summed afterwards. The thumbnail has one pixel a luminance block, from the DC
coefficient alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspan.llm.common import SLICE_BYTES, text_slices, tidy

UNIT = 576
ROW = 3  # blocks in a row of blocks of a small image; larger ones get wider rows, as no side may exceed 65,535
MAX_ROWS = 8191
PART = 1 << 15  # blocks that are coded at once


def code_table(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A canonical Huffman table from code lengths by symbol: the DHT body, and codes and lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    codes, sizes, code, last = np.zeros(256, np.uint32), np.zeros(256, np.uint32), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    return counts + bytes(order), codes, sizes


#: Code lengths by rule: sizes that letters and spaces have get the short codes, other sizes without a run the middle
#: ones, and all runs of zeros long ones. Sizes go to 8, as coefficients are within -128 and 127.
DC_BODY, DC_CODE, DC_SIZE = code_table({s: 3 if 2 < s < 8 and s != 6 else 4 for s in range(9)})
AC_BODY, AC_CODE, AC_SIZE = code_table({(run << 4) | s: (3 if s in (3, 4, 5, 7) else 4 if s in (6, 8) else 6) if run == 0 and s else 10 for run in range(16) for s in range(9) if s or run in (0, 15)})
_BITS = np.array([int(abs(v)).bit_length() for v in range(-128, 128)], np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down of an image that holds so many; the last row may have spare ones."""
    across = ROW * -(-blocks // (ROW * MAX_ROWS))
    return across, -(-blocks // across)


def _scan(coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of blocks (n x 64), stuffed and padded, end to end, and their lengths by block."""
    n = len(coefficients)
    block, place = np.nonzero(coefficients[:, 1:])
    values = coefficients[:, 1:][block, place].astype(np.int64)
    before = np.concatenate([[-1], place[:-1]])
    before[np.concatenate([[True], block[1:] != block[:-1]])[: len(block)]] = -1
    run = place - before - 1
    size = _BITS[values + 128]
    symbol = ((run & 15) << 4) | size
    # Codes by position: DC, then for each coefficient its ZRLs, its symbol and its bits, then EOB.
    dc = coefficients[:, 0].astype(np.int64)
    dc_size = _BITS[dc + 128]
    low = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    longs = np.flatnonzero(run > 15)
    zrl = np.repeat(longs, run[longs] >> 4)
    tail = np.full(n, -1)
    tail[block] = place  # the last one stays
    eob = np.flatnonzero(tail < 62)
    at_block = np.concatenate([np.arange(n), block, block[zrl], eob])
    at_place = np.concatenate([np.full(n, -1), place * 2 + 1, place[zrl] * 2, np.full(len(eob), 200)])
    code = np.concatenate([(DC_CODE[dc_size].astype(np.int64) << dc_size) | low(dc, dc_size), (AC_CODE[symbol].astype(np.int64) << size) | low(values, size), np.full(len(zrl), AC_CODE[0xF0], np.int64), np.full(len(eob), AC_CODE[0], np.int64)])
    bits = np.concatenate([DC_SIZE[dc_size] + dc_size, AC_SIZE[symbol] + size, np.full(len(zrl), AC_SIZE[0xF0]), np.full(len(eob), AC_SIZE[0])]).astype(np.int64)
    order = np.argsort(at_block * 256 + at_place, kind="stable")
    at_block, code, bits = at_block[order], code[order], bits[order]
    total = np.bincount(at_block, bits, minlength=n).astype(np.int64)
    length = (total + 7) >> 3
    first = np.cumsum(length) - length
    ends = np.cumsum(bits)
    base = (np.cumsum(total) - total)[at_block]
    start = ends - bits - base + first[at_block] * 8
    # A code has at most 18 bits, so it touches at most 4 bytes: one 32-bit word from its first byte.
    word = code << (32 - bits - (start & 7))
    out = np.zeros(int(length.sum()) + 4, np.int64)
    for k in range(4):
        out += np.bincount((start >> 3) + k, (word >> (24 - 8 * k)) & 255, minlength=len(out)).astype(np.int64)[: len(out)]
    spare = length * 8 - total
    out[first + length - 1] |= (1 << spare) - 1  # padded with ones
    out = out[:-4].astype(np.uint8)
    full = out == 255
    many = np.bincount(np.repeat(np.arange(n), length)[full], minlength=n)
    return np.insert(out, np.flatnonzero(full) + 1, 0), length + many


def store(payloads: list[bytes], n_bytes: list[int]) -> list[bytes]:
    """A baseline JPEG for each payload (a multiple of 64 bytes); the comment says its length and its n_bytes."""
    sides = [shape(len(p) // 64) for p in payloads]
    blocks = np.array([a * d for a, d in sides], np.int64)
    data = np.frombuffer(b"".join(p + b"\x80" * (64 * int(n) - len(p)) for p, n in zip(payloads, blocks, strict=True)), np.uint8)
    whole = data.reshape(-1, 64).astype(np.int16) - 128
    number = np.arange(len(whole)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # of a block in its image
    scans, lengths = [], []
    for at in range(0, len(whole), PART):
        scan, length = _scan(whole[at : at + PART])
        n = len(length)
        out = np.zeros(len(scan) + 2 * n, np.uint8)
        ends = np.cumsum(length + 2)
        out[np.arange(len(scan)) + 2 * np.repeat(np.arange(n), length)] = scan
        out[ends - 2], out[ends - 1] = 255, 0xD0 + (number[at : at + n] & 7)
        scans.append(out.tobytes())
        lengths.append(length + 2)
    scan, ends = b"".join(scans), np.cumsum(np.concatenate(lengths)) if lengths else np.zeros(0, np.int64)
    made, begin = [], 0
    for payload, n, (across, down), last in zip(payloads, n_bytes, sides, np.cumsum(blocks), strict=True):
        head = b"\xff\xd8" + _segment(0xFE, struct.pack(">QQ", len(payload), n)) + _segment(0xDB, b"\0" + b"\1" * 64)
        head += _segment(0xC0, struct.pack(">BHHB3B", 8, down * 8, across * 8, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + DC_BODY) + _segment(0xC4, b"\x10" + AC_BODY)
        head += _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
        end = int(ends[last - 1])
        made.append(head + scan[begin : end - 2] + b"\xff\xd9")  # the end of the image takes the place of the last restart
        begin = end
    return made


@dataclass
class Part:
    """A component: its sampling factors, quantization table and blocks across and down (with those that fill up MCUs)."""

    across: int
    down: int
    quantizer: int
    blocks: tuple[int, int] = (0, 0)


@dataclass
class Scan:
    """Components of a scan as (number, DC table, AC table), where its data lies, and the restart interval at that place."""

    parts: list[tuple[int, tuple, tuple]]
    begin: int
    end: int
    interval: int


@dataclass
class Image:
    """What the segments of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    parts: list[Part] = field(default_factory=list)
    scans: list[Scan] = field(default_factory=list)
    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""

    def true_blocks(self, k: int) -> tuple[int, int]:
        """Blocks across and down that show something of component k."""
        most_across, most_down = (max(x) for x in zip(*((p.across, p.down) for p in self.parts), strict=True))
        p = self.parts[k]
        return -(-(-(-self.width * p.across // most_across)) // 8), -(-(-(-self.height * p.down // most_down)) // 8)


_DATA_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


def parse(image: bytes) -> Image:
    """The segments of a baseline JPEG. A file that is none, or that ends early, is a ValueError."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    found, ids, tables, interval, at = Image(), [], {}, 0, 2
    try:
        while True:
            if image[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            while image[at + 1] == 0xFF:  # fill bytes
                at += 1
            kind = image[at + 1]
            if kind == 0xD9:
                break
            (size,) = struct.unpack_from(">H", image, at + 2)
            body = image[at + 4 : at + 2 + size]
            at += 2 + size
            if kind == 0xC0:
                bits, found.height, found.width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or found.parts or not found.height or not found.width:
                    raise ValueError("only one frame of 8 bits with both sizes")
                ids = [body[6 + 3 * k] for k in range(n)]
                found.parts = [Part(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
                most_across, most_down = max(p.across for p in found.parts), max(p.down for p in found.parts)
                for p in found.parts:
                    p.blocks = -(-found.width // (8 * most_across)) * p.across, -(-found.height // (8 * most_down)) * p.down
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    tables[body[0]] = (body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif kind == 0xDB:
                while body:
                    wide = body[0] >> 4
                    found.quantization[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                    body = body[65 + 64 * wide :]
            elif kind == 0xDD:
                (interval,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                found.comment = body
            elif kind == 0xDA:
                chosen = [(ids.index(body[1 + 2 * k]), tables[body[2 + 2 * k] >> 4], tables[16 | (body[2 + 2 * k] & 15)]) for k in range(body[0])]
                end = _DATA_END.search(image, at)
                found.scans.append(Scan(chosen, at, end.start() if end else len(image), interval))
                if not end:
                    break
                at = end.start()
    except (IndexError, KeyError, struct.error) as e:
        raise ValueError(f"not a whole JPEG: {e!r}") from e
    if not found.scans or {k for s in found.scans for k, *_ in s.parts} != set(range(len(found.parts))):
        raise ValueError("components without a scan")
    return found


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """By the next 16 bits: the symbol times 32 and the length of its code; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for n, count in enumerate(table[0], 1):
        for s in table[1][k : k + count]:
            out[code << (16 - n) : (code + 1) << (16 - n)] = s * 32 + n
            code += 1
        k += count
        code <<= 1
    return out


def _order(image: Image, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(component, block number in it) of the blocks of a scan in its order, a row an MCU."""
    if len(scan.parts) == 1:  # blocks in rows, none to fill up MCUs
        k = scan.parts[0][0]
        across, down = image.true_blocks(k)
        number = np.arange(down)[:, None] * image.parts[k].blocks[0] + np.arange(across)[None]
        return np.full((across * down, 1), k), number.reshape(-1, 1)
    first = image.parts[scan.parts[0][0]]
    across, down = first.blocks[0] // first.across, first.blocks[1] // first.down
    y, x = np.divmod(np.arange(across * down), across)
    which, number = [], []
    for k, *_ in scan.parts:
        p = image.parts[k]
        for v in range(p.down):
            for h in range(p.across):
                which.append(np.full(len(x), k))
                number.append((y * p.down + v) * p.blocks[0] + x * p.across + h)
    return np.stack(which, axis=1), np.stack(number, axis=1)


def coefficients(images: list[bytes], headers: list[Image]) -> list[list[np.ndarray]]:
    """Quantized coefficients (blocks x 64, zigzag order) of every component of parsed images."""
    known: dict[tuple, int] = {}
    base: list[list[int]] = []  # where the blocks of each component begin
    total = 0
    for h in headers:
        base.append([])
        for p in h.parts:
            base[-1].append(total)
            total += p.blocks[0] * p.blocks[1]
    # Blocks of all scans in the order of their codes: where they go, by which tables, and in which restart interval.
    data, target, dc_table, ac_table, lane_size, chain = [], [], [], [], [], []
    lanes = 0
    for image, h, start in zip(images, headers, base, strict=True):
        for scan in h.scans:
            which, number = _order(h, scan)
            mcus, per = which.shape
            numbers = {k: (known.setdefault(dc, len(known)), known.setdefault(ac, len(known))) for k, dc, ac in scan.parts}
            row = which[0] if mcus else np.zeros(0, int)
            target.append((number + np.array([start[k] for k in row])).ravel())
            dc_table.append(np.tile(np.array([numbers[k][0] for k in row], np.int16), mcus))
            ac_table.append(np.tile(np.array([numbers[k][1] for k in row], np.int16), mcus))
            step = scan.interval or mcus
            sizes = np.full(-(-mcus // step), step * per)
            sizes[-1] -= sizes.sum() - mcus * per
            lane_size.append(sizes)
            # DC differences run within a component of a restart interval.
            chain.append(((np.arange(mcus) // step + lanes)[:, None] * 256 + which).ravel())
            lanes += len(sizes)
            data += [image[scan.begin : scan.end], b"\xff\xd9"]
    target, dc_table, ac_table, lane_size, chain = (np.concatenate(x) for x in (target, dc_table, ac_table, lane_size, chain))
    tables = np.stack([_lookup(t) for t in known])
    raw = np.frombuffer(b"".join(data), np.uint8)
    mark = np.flatnonzero(raw[:-1] == 255)
    kind = raw[mark + 1]
    ends = mark[(kind >= 0xD0) & (kind <= 0xD9)]
    if len(ends) != lanes:
        raise ValueError("restart markers are missing")
    keep = np.ones(len(raw), bool)
    keep[mark[kind == 0] + 1] = False
    shift = np.cumsum(~keep)
    starts = np.concatenate([[0], ends[:-1] + 2])
    starts, stops = starts - shift[starts], ends - shift[ends]
    clean = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(np.uint32)
    words = (clean[:-4].astype(np.uint64) << 32) | (clean[1:-3].astype(np.uint64) << 24) | (clean[2:-2].astype(np.uint64) << 16) | (clean[3:-1].astype(np.uint64) << 8) | clean[4:].astype(np.uint64)
    words = words.astype(np.int64)  # the 40 bits from each byte
    out = np.zeros((total, 64), np.int16)
    first = np.cumsum(lane_size) - lane_size
    for part in range(0, lanes, PART):
        lane = np.arange(part, min(part + PART, lanes))
        unit, last, bit, most = first[lane], first[lane] + lane_size[lane], starts[lane].astype(np.int64) * 8, stops[lane].astype(np.int64) * 8
        place = np.full(len(lane), -1)  # of the coefficient before; -1: the DC coefficient is next
        while len(unit):
            next40 = words[bit >> 3] << (bit & 7)
            opening = place < 0
            got = tables[np.where(opening, dc_table[unit], ac_table[unit]), (next40 >> 24) & 0xFFFF]
            used = got & 31
            symbol = got >> 5
            size = symbol & 15
            raw_bits = ((next40 << used) >> (40 - size)) & ((1 << size) - 1)
            value = np.where(raw_bits < (1 << size) >> 1, raw_bits - (1 << size) + 1, raw_bits)
            place = np.where(opening, 0, place + (symbol >> 4) + 1)
            bit = bit + used + size
            put = size > 0
            if not used.all() or (bit > most).any() or (place[put] > 63).any():
                raise ValueError("bits that are no code")
            out[target[unit[put]], place[put]] = value[put]
            done = (place >= 63) | (~opening & (symbol == 0))
            if done.any():
                unit = unit + done
                place = np.where(done, -1, place)
                live = unit < last
                if not live.all():
                    unit, last, bit, most, place = unit[live], last[live], bit[live], most[live], place[live]
    # Sums of the differences, which begin anew with each chain.
    if len(chain) > lanes:
        order = np.argsort(chain, kind="stable")
        dc = out[target[order], 0].astype(np.int64)
        sums = np.cumsum(dc)
        new = np.concatenate([[True], chain[order][1:] != chain[order][:-1]])
        out[target[order], 0] = sums - np.repeat((sums - dc)[new], np.diff(np.append(np.flatnonzero(new), len(dc))))
    return [[out[at : at + p.blocks[0] * p.blocks[1]] for at, p in zip(start, h.parts, strict=True)] for start, h in zip(base, headers, strict=True)]


def thumbnail(image: Image, luminance: np.ndarray) -> np.ndarray:
    """A pixel for each block of the first component, from its DC coefficient."""
    p = image.parts[0]
    across, down = image.true_blocks(0)
    step = int(image.quantization[p.quantizer][0])
    pixels = np.clip(np.round(luminance[:, 0].astype(np.float64) * step / 8) + 128, 0, 255).astype(np.uint8)
    return pixels.reshape(p.blocks[1], p.blocks[0])[:down, :across]


def restore(images: list[bytes]) -> list[tuple[bytes, int, Image, np.ndarray]]:
    """For each image of `store`: the payload, the unpadded length, what `parse` found, and the thumbnail."""
    headers = [parse(image) for image in images]
    out = []
    for h, (blocks,) in zip(headers, coefficients(images, headers) if images else [], strict=True):
        size, n_bytes = struct.unpack(">QQ", h.comment)
        out.append(((blocks + 128).astype(np.uint8).tobytes()[:size], n_bytes, h, thumbnail(h, blocks)))
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits: an 8 x 8 grid of nearest pixels of the thumbnail, each above its mean or not."""
    h, w = thumbnail.shape
    grid = thumbnail[np.arange(8) * h // 8][:, np.arange(8) * w // 8].astype(np.float64)
    return np.packbits(grid > grid.mean()).tobytes().hex()


def described(image: Image, thumbnail: np.ndarray) -> str:
    return f"{image.width}x{image.height}:{average_hash(thumbnail)}:{sha256(np.ascontiguousarray(thumbnail).tobytes()).hexdigest()}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", images: bool = False) -> DataFrame:
    """A row a document: its text as a JPEG, and what reading that back gives. With `images`, the JPEG as column `media`.

    The payload is the UTF-8 text and bytes 255 up to a positive multiple of 576; a null or empty text is 576 of them.
    `feature` is width x height in pixels, the average hash and the sha-256 of the thumbnail. Repeated rows and equal
    texts give equal values; null ids stay null; no shuffle, and memory for one document or slice.
    """

    def run(batches):
        for keys, texts in text_slices(batches):
            rows = []
            raw = [t.encode("utf-8") for t in texts]
            made = store([r + b"\xff" * ((-len(r)) % UNIT if r else UNIT) for r in raw], [len(r) for r in raw])
            for key, image, (payload, n, found, small) in zip(keys, made, restore(made), strict=True):
                feature = described(found, small)
                rows.append((key, n, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), sha256(image).hexdigest(), feature, *[image] * images))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * images
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")] + ["media"] * images)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidy(run), SCHEMA + ", media binary" * images)


def thumbnails(rows: DataFrame, id_col: str = "image_id", image_col: str = "image") -> DataFrame:
    """(id, width, height, thumbnail_hash, thumbnail_sha256, thumbnail, error) of a column of JPEGs, one row each.

    What is no whole baseline JPEG has an error and nulls, and spoils no other row; a null image has nulls alone. The
    thumbnail is its pixels by rows. Equal images give equal values; images are decoded together up to SLICE_BYTES.
    """

    def one(image: bytes | None) -> tuple:
        if image is None:
            return (None,) * 6
        try:
            h = parse(image)
            small = thumbnail(h, coefficients([image], [h])[0][0])
        except (ValueError, KeyError, IndexError) as e:
            return (None,) * 5 + (str(e),)
        return h.width, h.height, average_hash(small), sha256(np.ascontiguousarray(small).tobytes()).hexdigest(), small.tobytes(), None

    def together(images: list[bytes]) -> list[tuple]:
        try:
            headers = [parse(image) for image in images]
            found = [thumbnail(h, blocks[0]) for h, blocks in zip(headers, coefficients(images, headers), strict=True)]
        except (ValueError, KeyError, IndexError):
            return [one(image) for image in images]
        return [(h.width, h.height, average_hash(s), sha256(np.ascontiguousarray(s).tobytes()).hexdigest(), s.tobytes(), None) for h, s in zip(headers, found, strict=True)]

    def run(batches):
        for batch in batches:
            images = batch.column(1).to_pylist()
            out: list[tuple] = [(None,) * 6] * len(images)
            group: list[int] = []
            for k in [*(k for k, i in enumerate(images) if i is not None), None]:
                if group and (k is None or sum(len(images[g]) for g in group) + len(images[k]) > SLICE_BYTES):
                    for g, r in zip(group, together([images[g] for g in group]), strict=True):
                        out[g] = r
                    group = []
                if k is not None:
                    group.append(k)
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.string()]
            yield pa.record_batch([batch.column(0), *(pa.array([r[c] for r in out], t) for c, t in enumerate(kinds))], names=["id", "width", "height", "thumbnail_hash", "thumbnail_sha256", "thumbnail", "error"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast("binary").alias("image")).mapInArrow(tidy(run), "id long, width int, height int, thumbnail_hash string, thumbnail_sha256 string, thumbnail binary, error string")
