"""Tables that batches are merged into."""
