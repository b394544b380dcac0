"""The engine's relational operators: numbering, hard links, bundle planning, paths, frames, restoring."""
