from tickloom.sources.envelopes import unwrap_envelope
from tickloom.sources.records import kafka_options, read_records, stream_records

__all__ = ["kafka_options", "read_records", "stream_records", "unwrap_envelope"]
