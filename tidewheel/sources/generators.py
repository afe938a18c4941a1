"""Sources in Python: a counter that resumes from its offset, and seeded record generators."""

from __future__ import annotations

import random

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class Range(InputPartition):
    def __init__(self, task: int, start: int, end: int):
        self.task, self.start, self.end = task, start, end


class CounterStream(DataSourceStreamReader):
    """Counts on by ``step`` for each of ``tasks`` tasks; the offset of the stream is the count reached, kept in the checkpoint."""

    def __init__(self, options):
        self.tasks, self.step, self.most = int(options.get("tasks", 1)), int(options.get("step", 10)), int(options.get("most", 100))
        self.now = 0

    def initialOffset(self):
        return {"count": 0}

    def latestOffset(self):
        self.now = min(self.now + self.step, self.most)
        return {"count": self.now}

    def partitions(self, start, end):
        self.now = max(self.now, end["count"])
        return [Range(t, start["count"], end["count"]) for t in range(self.tasks)]

    def read(self, partition):
        for i in range(partition.start, partition.end):
            yield partition.task, i

    def commit(self, end):
        pass


class CounterBatch(DataSourceReader):
    def __init__(self, options):
        self.tasks, self.most = int(options.get("tasks", 1)), int(options.get("most", 100))

    def partitions(self):
        return [Range(t, 0, self.most) for t in range(self.tasks)]

    def read(self, partition):
        for i in range(partition.start, partition.end):
            yield partition.task, i


class Counter(DataSource):
    @classmethod
    def name(cls):
        return "counter"

    def schema(self):
        return "task int, n long"

    def reader(self, schema):
        return CounterBatch(self.options)

    def streamReader(self, schema):
        return CounterStream(self.options)


class Readings(DataSource):
    """Seeded speed readings: the same options give the same rows, whatever task makes them."""

    @classmethod
    def name(cls):
        return "readings"

    def schema(self):
        return "trap int, plate string, speed double"

    def reader(self, schema):
        return ReadingsReader(self.options)


class ReadingsReader(DataSourceReader):
    def __init__(self, options):
        self.traps, self.rows, self.seed = int(options.get("traps", 4)), int(options.get("rows", 100)), options.get("seed", "1")

    def partitions(self):
        return [Range(t, 0, self.rows) for t in range(self.traps)]

    def read(self, partition):
        rng = random.Random(f"{self.seed}:{partition.task}")
        for _ in range(partition.start, partition.end):
            yield partition.task, f"{rng.randrange(10**6):06d}", round(rng.gauss(80, 15), 1)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Counter)
    spark.dataSource.register(Readings)
