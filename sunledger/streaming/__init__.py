"""The rollup to the working grid as a Structured Streaming job."""
