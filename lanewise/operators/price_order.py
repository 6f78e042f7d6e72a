"""The cards of a lane by price for each weight: whole numbers, a block of requests at a time.

Runs in Arrow workers.  A price is that of ``pricing.cwt_charge``, as a whole number of 10**-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lanewise.functions.pricing import WHOLE_MOST

QUOTES_PER_BLOCK = 1 << 17
LEAST_PER_BLOCK = 8  # requests, as each block repeats the lane's cards
QUOTES_AT_ONCE = 1 << 15  # their numbers stay in a core's cache
PER_CENT, PER_AMOUNT = 10 ** 10, 10 ** 8  # products are in 10**-12, amounts in 10**-4
MOST_AMOUNT = WHOLE_MOST // PER_AMOUNT
BEYOND = 10 ** 18


class Cards:
    """The cards of a lane as ``pricing.cwt_charge`` sees them, with the place of each as its tie-break."""

    def __init__(self, whole: pa.Array, amount: pa.Array) -> None:
        self.n = len(whole)
        self.given = whole, amount
        self.whole = whole.fill_null(0).to_numpy(zero_copy_only=False)
        self.amount = amount.fill_null(0).to_numpy(zero_copy_only=False)
        floor = np.clip(self.amount, -1, MOST_AMOUNT + 1) * PER_AMOUNT
        floor[amount.is_null().to_numpy(zero_copy_only=False)] = -1
        floor[whole.is_null().to_numpy(zero_copy_only=False)] = (MOST_AMOUNT + 1) * PER_AMOUNT
        self.floor = floor
        self.places = np.arange(self.n)
        self.bits = self.n.bit_length()
        room = 1 << (62 - self.bits)
        fits = (self.whole.min() >= 0 and -room < self.amount.min() and self.amount.max() < room
                and MOST_AMOUNT + 100 < room)
        self.reach = WHOLE_MOST // max(int(self.whole.max()), 1) if fits else -1

    def quotes(self, cwt: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row per weight from the cheapest card: places and prices."""
        known = cwt.fill_null(-1).to_numpy(zero_copy_only=False)
        quick = (known >= 0) & (known <= self.reach)
        places = np.empty((len(cwt), self.n), np.int32)
        prices = np.empty((len(cwt), self.n), np.int64)
        at = np.flatnonzero(quick)
        step = max(1, QUOTES_AT_ONCE // self.n)
        for some in (at[i:i + step] for i in range(0, len(at), step)):
            places[some], prices[some] = self._quick(known[some])
        for i in np.flatnonzero(~quick):
            places[i], prices[i] = self._exact(cwt[i].as_py())
        return places, prices

    def _quick(self, cwt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Price and place are one long, so that rows are sorted as plain numbers."""
        product = cwt[:, None] * self.whole
        both = np.where(product < self.floor, self.amount,
                        (product + PER_CENT // 2) // PER_CENT * 100)
        both *= 1 << self.bits
        both += self.places
        both.sort(axis=1)
        return both & ((1 << self.bits) - 1), both >> self.bits

    def _exact(self, cwt: int | None) -> tuple[list[int], list[int]]:
        """The same for numbers of any size and sign, or none.  A price that no long holds comes as one that
        ``pricing.amount`` cannot hold either."""
        def price(whole: int | None, amount: int | None) -> int:
            if cwt is None or whole is None:
                return amount or 0
            product = cwt * whole
            if amount is not None and product < amount * PER_AMOUNT:
                return amount
            cents = (abs(product) + PER_CENT // 2) // PER_CENT * 100
            return cents if product >= 0 else -cents

        prices = [*map(price, *(column.to_pylist() for column in self.given))]
        places = sorted(range(self.n), key=prices.__getitem__)
        return places, [max(-BEYOND, min(prices[i], BEYOND)) for i in places]


ASKED, OFFERED = ("weight_lbs",), ("carrier_id", "carrier_name", "transit_days")


def _lists(parts: list[pa.Array]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(part) for part in parts])))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(parts))


def _packed(blocks: list[tuple]) -> pa.RecordBatch:
    lanes, *columns = zip(*blocks)
    return pa.RecordBatch.from_arrays([pa.array(lanes, pa.string()), *map(_lists, columns)],
                                      ["lane_id", *ASKED, *OFFERED, "place", "price"])


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Stretches of a batch that are cards, or requests, of one lane and cut."""
    lane, cut = (batch.column(name).dictionary_encode().indices.to_numpy() for name in ("lane_id", "cut"))
    asks = batch.column("asks").to_numpy(zero_copy_only=False)
    new = (lane[1:] != lane[:-1]) | (cut[1:] != cut[:-1]) | (asks[1:] != asks[:-1])
    borders = [0, *(np.flatnonzero(new) + 1).tolist(), len(lane)]
    for begin, end in zip(borders, borders[1:]):
        key = batch.column("lane_id")[begin].as_py(), batch.column("cut")[begin].as_py()
        yield key, bool(asks[begin]), batch.slice(begin, end - begin)


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of requests of a lane with its cards, and for one request after another the places of the
    cards from the cheapest and the prices.

    Rows come by lane and cut, the cards in carrier order before the requests.  The cards of one cut and a
    block of quotes are held.
    """
    at, held, cards, offered, blocks, quotes = None, [], None, [], [], 0
    for batch in batches:
        for key, asks, rows in _runs(batch) if batch.num_rows else ():
            if key != at:
                at, held, cards = key, [], None
            if not asks:
                held.append(rows)
                continue
            if not held:
                continue
            if cards is None:
                whole, amount, *offered = (pa.concat_arrays([part.column(name) for part in held])
                                           for name in ("whole", "amount", *OFFERED))
                cards = Cards(whole, amount)
            per_block = max(LEAST_PER_BLOCK, QUOTES_PER_BLOCK // cards.n)
            for first in range(0, rows.num_rows, per_block):
                block = rows.slice(first, per_block)
                found = cards.quotes(block.column("whole_cwt"))
                blocks.append((key[0], *(block.column(name) for name in ASKED), *offered,
                               *(pa.array(column.ravel()) for column in found)))
                quotes += found[0].size
                if quotes >= QUOTES_PER_BLOCK:
                    yield _packed(blocks)
                    blocks, quotes = [], 0
    if blocks:
        yield _packed(blocks)
