"""Rules over event streams on Structured Streaming; each gives the rows of its batch form, and replays change nothing."""
