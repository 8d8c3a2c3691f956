"""Log shipping: a follower streams the leader's commit files and applies each once, in order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from ..errors import ConflictError, CorruptionError
from ..model import EDGE_RECORD, NODE_RECORD, promote
from ..sources.store import Store


class Follower:
    """A store that only applies. Commits at or below its version are ignored; a smaller term than the last is refused."""

    def __init__(self, leader: Store, store: Store):
        self.leader, self.store = leader, store
        last = store.versions()
        self.term = store.commit_record(last[-1])["term"] if last else 0

    @property
    def lag(self) -> int:
        return self.leader.version - self.store.version

    def apply(self, content: dict) -> bool:
        version = content["version"]
        if version <= self.store.version:
            return False
        if content["term"] < self.term:
            raise ConflictError(f"term {content['term']} is behind {self.term}")
        if version != self.store.version + 1:
            raise CorruptionError(f"version {self.store.version + 1} is missing before {version}")
        spark, path = self.store.spark, f"{self.leader.base}/{content['path']}"
        read = lambda part, schema: spark.read.schema(schema).parquet(f"{path}/{part}")
        self.store.term, self.store.source = content["term"], content["source"]
        self.store.write_frames(promote(read("nodes", NODE_RECORD)), read("edges", EDGE_RECORD), read("node_deletes", "id string"), read("edge_deletes", "id string"), self.store.version)
        self.term = content["term"]
        return True

    def pull(self) -> int:
        """All commits there are, without a stream; how many were new."""
        return sum(self.apply(self.leader.commit_record(v)) for v in self.leader.versions() if v > self.store.version)

    def stream(self, checkpoint: str, once: bool = True):
        """A streaming query over the leader's commit folder; with once, it ends when it has caught up."""
        commits = self.store.spark.readStream.schema("value string").option("wholetext", True).option("pathGlobFilter", "[0-9]*.json").text(f"{self.leader.base}/_commits")

        def each(rows: DataFrame, _: int) -> None:
            found = [json.loads(r["value"])["content"] for r in rows.collect()]  # commit records, not data
            for content in sorted(found, key=lambda c: c["version"]):
                self.apply(content)

        writer = commits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
