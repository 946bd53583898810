"""Static range asymmetric numeral coding of token ids, many interleaved lanes at once.

A block holds up to ``BLOCK`` ids and is decoded alone: lane j codes ids j, j + lanes, ... of it
with a 64-bit state and 32-bit words. Between its ``STEPS`` sections lie checkpoints (the lane
states and the place in the words), so a section can be decoded without those before it. A CRC-32
of the ids guards each block.
"""

import struct
import zlib

import numpy as np

BLOCK, LANES, SECTIONS = 1 << 19, 2048, 2
BITS = 19  # frequencies sum to 1 << BITS
LOW = 1 << 31  # least state
HEAD = struct.Struct("<4sIIIII")  # magic, ids, lanes, words, sections, CRC-32
MAGIC = b"RNS1"


class Table:
    """Frequencies of the ids, scaled to ``1 << BITS`` with at least 1 for each id that occurs."""

    def __init__(self, ids, counts):
        ids, counts = np.asarray(ids, np.int64), np.asarray(counts, np.float64)
        order = np.argsort(ids)
        self.ids, counts = ids[order].astype(np.uint32), counts[order]
        room = (1 << BITS) - len(ids)
        freq = 1 + np.floor(counts / max(1.0, counts.sum()) * room).astype(np.int64)
        if len(ids):
            freq[counts.argmax()] += (1 << BITS) - freq.sum()
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = None
        self.place = np.zeros(int(self.ids[-1]) + 1 if len(self.ids) else 1, np.int32)
        self.place[self.ids] = np.arange(len(self.ids))

    def places(self, ids):
        return self.place[ids]

    def symbols(self):
        """Place of the id for each of the ``1 << BITS`` slots."""
        if self.slot is None:
            kind = np.uint16 if len(self.ids) <= 1 << 16 else np.uint32
            self.slot = np.repeat(np.arange(len(self.ids), dtype=kind),
                                  self.freq.astype(np.int64))
        return self.slot


def encode(ids, table):
    """One block as bytes."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    lanes = max(1, min(LANES, n // 256))
    steps = -(-n // lanes)
    at = table.places(ids)
    freq, start = table.freq[at], table.start[at]
    state, words, marks = np.full(lanes, LOW, np.uint64), [], []
    sections = max(1, min(SECTIONS, steps // 64))
    cuts = {steps * k // sections for k in range(1, sections)}
    total = 0
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * lanes:(step + 1) * lanes], start[step * lanes:(step + 1) * lanes]
        x = state[:len(f)]  # changed in place
        full = np.flatnonzero(x >> np.uint64(63 - BITS) >= f)
        if len(full):
            out = x.take(full)
            words.append(out.astype(np.uint32)[::-1])  # read backwards by the decoder
            total += len(out)
            x[full] = out >> np.uint64(32)
        q = x // f
        x -= q * f
        q <<= np.uint64(BITS)
        x += q
        x += c
        if step in cuts:
            marks.append((step, total, state.copy()))
    # The decoder reads the words from the last written to the first.
    stream = np.concatenate(words)[::-1] if words else np.empty(0, np.uint32)
    body = [state.tobytes()]
    for step, done, own in reversed(marks):
        body += [struct.pack("<II", step, total - done), own.tobytes()]
    head = HEAD.pack(MAGIC, n, lanes, total, sections, zlib.crc32(ids.astype("<u4").tobytes()))
    return head + b"".join(body) + stream.astype("<u4").tobytes()


def size(data):
    """Ids in a block."""
    return HEAD.unpack_from(data)[1]


def decode(data, table, first=0, last=None):
    """Ids ``first`` to ``last`` of a block, from the checkpoint before ``first``.

    A whole block is checked against its checksum.
    """
    magic, n, lanes, total, sections, check = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    last = n if last is None else min(last, n)
    at = HEAD.size
    begin, place = 0, 0
    state = np.frombuffer(data, "<u8", lanes, at).copy()
    at += 8 * lanes
    for _ in range(sections - 1):
        step, read = struct.unpack_from("<II", data, at)
        if step * lanes <= first:
            begin, place = step, read
            state = np.frombuffer(data, "<u8", lanes, at + 8).copy()
        at += 8 + 8 * lanes
    words = np.frombuffer(data, "<u4", total, at).astype(np.uint64)
    slots, mask = table.symbols(), np.uint64((1 << BITS) - 1)
    end = -(-last // lanes)
    out = np.empty(max(0, min(end * lanes, n) - begin * lanes), np.uint32)
    for step in range(begin, end):
        width = min(lanes, n - step * lanes)
        x = state[:width]  # changed in place
        slot = x & mask
        sym = slots[slot.view(np.int64)].astype(np.intp)
        x >>= np.uint64(BITS)
        x *= table.freq[sym]
        x += slot
        x -= table.start[sym]
        short = np.flatnonzero(x < LOW)
        k = len(short)
        if k:
            x[short] = x.take(short) << np.uint64(32) | words[place:place + k]
            place += k
        out[(step - begin) * lanes:(step - begin) * lanes + width] = sym
    ids = table.ids[out]
    # The whole block leads back to the states the coder began with.
    if first == 0 and last == n and (
            (state != LOW).any() or zlib.crc32(ids.astype("<u4").tobytes()) != check):
        raise ValueError("block checksum differs")
    return ids[first - begin * lanes:last - begin * lanes]
