"""Rules as text, as Python and as a tree; their checks and their plans."""
