"""Sending objects of this package's classes to the tasks."""

from __future__ import annotations

import pickle
from typing import Any

from pyspark import SparkContext, cloudpickle
from pyspark.core.broadcast import Broadcast


def ship(sc: SparkContext, thing: Any) -> Broadcast:
    """Broadcast of an object with its class by value, so executors need no copy of the package. Callers bound
    the object's size."""
    return sc.broadcast(cloudpickle.dumps(thing))


def shipped(box: Broadcast) -> Any:
    """The object, unpacked once in each Python worker."""
    thing = getattr(box, "_thing", None)
    if thing is None:
        thing = box._thing = pickle.loads(box.value)
    return thing
