"""Training-data operators: ten whole-corpus steps, each with a general interface and a thin query."""
