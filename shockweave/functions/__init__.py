"""Column helpers shared by sources and operators."""
