"""A SPARQL 1.1 subset that compiles to DataFrame plans."""

from .compiler import Engine

__all__ = ["Engine"]
