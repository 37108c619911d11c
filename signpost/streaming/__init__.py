from signpost.streaming.circuit import read_circuits, read_decisions, stream_circuit
from signpost.streaming.manifests import stream_manifests
from signpost.streaming.route import stream_route
from signpost.streaming.usage import read_usage, stream_usage

__all__ = ["read_circuits", "read_decisions", "read_usage", "stream_circuit", "stream_manifests", "stream_route", "stream_usage"]
