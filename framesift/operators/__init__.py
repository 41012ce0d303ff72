"""Relational operators over frames, bursts, stacks, decisions and journals."""
