"""Paragraphs, slices and packing restated with plain loops, which the operators are held against."""

import re
from itertools import groupby
from typing import NamedTuple

from spindrift.operators.chunking import OVERLAP

# What a heading and a code fence look like.
HEADING = re.compile(r"^(#{1,6})\s+(\S.*?)\s*#*\s*$")
FENCE = re.compile(r"^\s*(```|~~~)")


class Block(NamedTuple):
    text: str
    start: int
    end: int
    heading: str


class Chunk(NamedTuple):
    text: str
    heading: str
    start: int
    end: int


def blocks(text: str) -> list[Block]:
    """Paragraphs between blank lines, each with its lines and the heading it stands under.

    A paragraph's first line is a heading only if no fence is open after the paragraph's last line.
    """
    numbered = list(enumerate(text.splitlines(), 1))
    out, heading, fences = [], "", 0
    for solid, group in groupby(numbered, lambda x: bool(x[1].strip())):
        if not solid:
            continue
        rows = list(group)
        fences += sum(1 for _, line in rows if FENCE.match(line))
        found = HEADING.match(rows[0][1].strip()) if fences % 2 == 0 else None
        heading = found[2] if found else heading
        out.append(Block("\n".join(line for _, line in rows).strip(), rows[0][0], rows[-1][0], heading))
    return out


def slices(block: Block, most: int):
    """Overlapping slices of a long paragraph; all but the first start after a blank, and each cites its own lines."""
    for at in range(0, len(block.text), most - OVERLAP):
        stop = min(at + most, len(block.text))
        blank = block.text.find(" ", at, stop) if at else -1
        first = at if blank < 0 else blank + 1
        yield Chunk(block.text[first:stop], block.heading, block.start + block.text.count("\n", 0, first), block.start + block.text.count("\n", 0, stop))


def _tail(held: list[Block]) -> Block:
    """The end of what is held, from a word's start, as a block that cites the line where it starts."""
    whole = "\n\n".join(b.text for b in held)
    tail = whole[-OVERLAP:]
    if len(tail) < len(whole):
        tail = tail[tail.find(" ") + 1 :]
    offset, at = len(whole) - len(tail), 0
    for b in held:
        if offset <= at + len(b.text):
            break
        at += len(b.text) + 2
    line = b.start + b.text.count("\n", 0, max(0, offset - at))
    return Block(tail, line, line, b.heading)


def chunks(text: str, most: int = 1500):
    """Paragraphs packed into chunks of about `most` characters, each but the first of a run opened by the end of the last.

    A chunk that opens with such a tail may be longer than `most` by the tail and two.
    """
    held: list[Block] = []

    def closed() -> Chunk:
        return Chunk("\n\n".join(b.text for b in held), held[0].heading, held[0].start, held[-1].end)

    for block in blocks(text):
        if len(block.text) > most:
            if held:
                yield closed()
            held = []
            yield from slices(block, most)
        elif not held or sum(len(b.text) + 2 for b in held) + len(block.text) <= most:
            held.append(block)
        else:
            yield closed()
            held = [_tail(held), block]
    if held:
        yield closed()


