"""Changes of a far mailbox as a stream whose offset is a modseq."""

from tidewater.streaming.changes import FarChanges, follow

__all__ = ["FarChanges", "follow"]
