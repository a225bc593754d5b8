"""Tables on disk: raw batches, pointers, the event store and its layouts."""
