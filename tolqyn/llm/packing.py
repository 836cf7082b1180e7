"""Problem 6: filling containers of fixed capacity along a space-filling curve.

Documents are range-sorted by the Hilbert key of their hashed word vectors, so a partition holds a stretch of the curve. Along it
windows of neighbours are packed, largest first, each into the open container with the least sufficient room; a
container closes when a later window is unlikely to fit it. Only a document larger than the capacity is divided: into pieces of
the capacity, which fill containers alone, and a rest, which is an item like others.

Defined results: documents of no tokens are items of size 0; repeated rows are packed each; ties are ordered by id;
an empty table gives no rows; the same input and settings give the same containers.
"""

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "profile string, capacity bigint, container_id string, doc_id bigint, part_no int, token_start bigint, tokens bigint"


class Packer:
    """Containers of one capacity. Items are (size, id, part, start)."""

    def __init__(self, profile: str, capacity: int, name: str, window: int, most_open: int):
        self.profile, self.capacity, self.name, self.window, self.most_open = profile, capacity, name, window, most_open
        self.rooms: list[tuple[int, int]] = []  # (room left, number) of open containers, in order
        self.items: list[tuple[int, int, int, int]] = []
        self.held: dict[int, list] = {}
        self.count = 0

    def rows(self, number: int, items):
        return [(self.profile, self.capacity, f"{self.name}-{number}", doc, part, start, size) for size, doc, part, start in items]

    def add(self, doc: int, size: int) -> list:
        """Take a document; gives back containers that are complete."""
        out, part, start = [], 0, 0
        while size - start > self.capacity:
            out += self.rows(self.count, [(self.capacity, doc, part, start)])
            self.count, part, start = self.count + 1, part + 1, start + self.capacity
        self.items.append((size - start, doc, part, start))
        return out + (self.pack(False) if len(self.items) >= self.window else [])

    def pack(self, last: bool) -> list:
        for item in sorted(self.items, key=lambda x: (-x[0], x[1], x[2])):
            i = bisect.bisect_left(self.rooms, (item[0], -1))
            if i < len(self.rooms):
                room, number = self.rooms.pop(i)
            else:
                room, number = self.capacity, self.count
                self.count += 1
                self.held[number] = []
            self.held[number].append(item)
            bisect.insort(self.rooms, (room - item[0], number))
        smallest = sorted(x[0] for x in self.items)[len(self.items) // 50] if self.items else 0
        self.items = []
        # full ones close; of the others the roomiest stay open
        done = len(self.rooms) if last else max(bisect.bisect_left(self.rooms, (smallest, -1)), len(self.rooms) - self.most_open)
        closed, self.rooms = self.rooms[:done], self.rooms[done:]
        return [r for _, number in closed for r in self.rows(number, self.held.pop(number))]


def pack(sized: DataFrame, limits: list[tuple[str, int]], window: int = 512, most_open: int = 64, rows_per_task: int = 250_000) -> DataFrame:
    """sized: doc_id, tokens, hkey. limits: (profile, capacity), a handful. One row per document part, SCHEMA."""
    spark = sized.sparkSession
    per = F.explode(F.array(*[F.struct(F.lit(p).alias("profile"), F.lit(int(c)).cast("bigint").alias("capacity")) for p, c in limits])).alias("l")
    rows = sized.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), "hkey", per).select("l.*", "doc_id", "tokens", "hkey")
    n = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(limits) * 2), rows.count() // rows_per_task)
    order = ("profile", "hkey", "doc_id")

    def run(batches):
        from pyspark import TaskContext

        at, packer = TaskContext.get().partitionId(), None
        for pdf in batches:
            out = []
            for profile, capacity, doc, size in zip(pdf.profile, pdf.capacity, pdf.doc_id, pdf.tokens):
                if packer is None or packer.profile != profile:
                    out += packer.pack(True) if packer else []
                    packer = Packer(profile, int(capacity), f"{profile}-{at}", window, most_open)
                out += packer.add(int(doc), int(size))
            yield pd.DataFrame(out, columns=_COLUMNS)
        if packer:
            yield pd.DataFrame(packer.pack(True), columns=_COLUMNS)

    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInPandas(run, SCHEMA)


_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def fill_report(packed: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Per profile: containers, tokens, the least number of containers that could do, and the share of room used.

    With sized (doc_id, hkey) also `spread`: how far the documents of a container lie from its middle on the curve, on average, as part of how
    far they lie from the middle of all; about 1 for containers filled in random order."""
    one = packed.groupBy("profile", "capacity", "container_id").agg(F.sum("tokens").alias("used"))
    got = one.groupBy("profile", "capacity").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    got = got.withColumn("least_containers", F.ceil(F.col("tokens") / F.col("capacity"))).withColumn("fill", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
    if sized is None:
        return got
    placed = packed.select("profile", "container_id", "doc_id").join(sized.select("doc_id", F.col("hkey").cast("double").alias("at")), "doc_id")
    middle = placed.groupBy("profile", "container_id").agg(F.avg("at").alias("mid"), F.count("*").alias("n")).where("n > 1")
    every = placed.groupBy("profile").agg(F.avg("at").alias("centre"))
    both = placed.join(middle, ["profile", "container_id"]).join(F.broadcast(every), "profile")  # a row per profile
    spread = both.groupBy("profile").agg(F.round(F.avg(F.abs(F.col("at") - F.col("mid"))) / F.avg(F.abs(F.col("at") - F.col("centre"))), 4).alias("spread"))
    return got.join(spread, "profile", "left")
