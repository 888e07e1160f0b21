"""Detectors as plug-ins: each maps packets to alerts, all are united in one stream."""

from pyspark.sql import DataFrame

from threatflow.operators import fusion


class Detectors:
    """A registry of detectors, run in the fixed detector order.

    A detector is a function from a packet DataFrame to an alert DataFrame.  One that
    works row by row is wrapped by ``row_detector`` and runs on Arrow batches.
    """

    def __init__(self):
        self._by_name = {}

    def add(self, name, detect):
        if name not in fusion.DETECTOR_ORDER:
            raise ValueError(f"unknown detector {name!r}")
        self._by_name[name] = detect
        return self

    def run(self, packets: DataFrame):
        return fusion.union_detectors({n: d(packets) for n, d in self._by_name.items()})


def row_detector(detect, schema):
    """Wrap ``detect(packet dict) -> alert dict or None``."""
    import pandas as pd

    def over(batches):
        for pdf in batches:
            found = [a for a in map(detect, pdf.to_dict("records")) if a is not None]
            if found:
                yield pd.DataFrame(found)

    return lambda packets: packets.mapInPandas(over, schema)
