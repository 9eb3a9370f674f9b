"""Learning from streams: mergeable states updated by micro-batches."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import DataIOError, Model, read_bytes, write_bytes
from ..operators.bayes import GaussianNB, GaussianState
from ..operators.iterative import ScoreModel, SgdClassifier


class _Streaming:
    """Keeps a model up to date with a stream; a batch seen twice counts once.

    ``writer(stream)`` gives a writer to start with a checkpoint location; ``state`` is the model so far. With
    ``path`` (a file beside the checkpoint, any store that Spark knows) the state is written after each batch, with the
    batch's number, and read when a new object starts: so a restarted stream goes on with all it has learned.
    """

    def learn(self, batch: DataFrame) -> Model:
        raise NotImplementedError

    def __post_init__(self) -> None:
        if self.path is None or self.state is not None:
            return
        try:
            saved = json.loads(read_bytes(self.path))
        except DataIOError:  # nothing learned yet
            return
        self.last, self.state = saved["last"], Model.from_json(saved["state"]) if saved["state"] else None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        if not batch.isEmpty():
            self.state = self.learn(batch)
        self.last = batch_id
        if self.path is not None:
            write_bytes(self.path, json.dumps({"last": self.last, "state": self.state.to_json() if self.state else None}).encode())

    def writer(self, stream: DataFrame):
        return stream.writeStream.foreachBatch(self.update)


@dataclass
class StreamingGaussianNB(_Streaming):
    """Gaussian naive Bayes: counts, means and variances of each class, merged batch by batch."""

    features: list[str]
    label: str
    nb: GaussianNB = field(default_factory=GaussianNB)
    state: GaussianState | None = None
    last: int = -1
    path: str | None = None

    def learn(self, batch: DataFrame) -> Model:
        return self.nb.partial_fit(self.state, batch, self.features, self.label)


@dataclass
class StreamingSgdClassifier(_Streaming):
    """A linear classifier by gradient steps: each batch goes on from the weights that the one before left.

    The classes are those of ``classes``, or those of the first batch; rows of others don't count.
    """

    features: list[str]
    label: str
    sgd: SgdClassifier = field(default_factory=lambda: SgdClassifier(epochs=1))
    classes: list | None = None
    state: ScoreModel | None = None
    last: int = -1
    path: str | None = None

    def learn(self, batch: DataFrame) -> Model | None:
        labels = self.state.labels if self.state is not None else self.classes
        if labels is not None:
            batch = batch.filter(F.col(f"`{self.label}`").isin(labels))
            if batch.isEmpty():
                return self.state
        if self.state is None and labels is not None:
            rows = 1 if len(labels) == 2 else len(labels)
            self.state = ScoreModel(self.features, np.zeros((rows, len(self.features))), np.zeros(rows), sorted(labels))
        return self.sgd.partial_fit(self.state, batch, self.features, self.label)
