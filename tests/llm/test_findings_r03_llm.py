"""What the review of round 3 found in the corpus operators."""

import random

import pyarrow as pa

from quillspark.llm import suffix_radix, windows


def test_a_shards_answers_do_not_depend_on_the_order_of_its_rows():
    """The rows of a shard are read several times, each time in the order in which a shuffle brings them."""
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcdé ") for _ in range(60)) for _ in range(12)]
    rows = [(i, "".join(rng.sample(lines, rng.randint(0, 5)))) for i in range(40)] + [(40, ""), (41, lines[0])]

    def shard(some: list) -> suffix_radix.Texts:
        return suffix_radix.Texts(pa.table({"shard": [3] * len(some), "id": [i for i, _ in some], "text": [t for _, t in some], "copies": [1] * len(some)}), 24)

    seeds = windows.all_of([b for c in ("once", "many") for b in shard(rows).minimisers(4)[c].to_pylist()])
    sent = suffix_radix.send(shard(rows), seeds, seeds[::3], 4)
    for _ in range(5):
        rng.shuffle(rows)
        again = shard(rows)
        assert [again.parts[at].decode() for at in again.row_text] == [t for _, t in rows]
        assert suffix_radix.send(again, seeds, seeds[::3], 4).equals(sent) and len(sent) > 3
