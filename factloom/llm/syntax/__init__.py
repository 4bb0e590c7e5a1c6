"""Lexers and grammars of four languages, and an error-correcting chart parser for all of them."""
