"""The event-log counts on a stream."""
