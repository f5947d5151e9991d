"""Space-delimited chunks of a text, for tokenizers that never merge across them.

A byte-level BPE vocabulary splits text by a pattern in which a space followed by
a visible character always starts a new word.  Cutting a text at its spaces and
putting the space in front of what follows therefore keeps every word whole, and a
chunk's tokens do not depend on its neighbours.  The exceptions are chunks that
begin with white space or with an added token: a run of white space may then reach
over the cut.  Texts with such a chunk are tokenized whole.
"""

from __future__ import annotations

CACHE_LIMIT = 1_200_000    # chunks remembered per worker; the cache starts anew beyond that
LONGEST = 64               # longer chunks hardly repeat and are not remembered


class Irregular(Exception):
    """The text has a chunk that does not stand alone."""


class ChunkCache(dict):
    """chunk -> value of ``' ' + chunk``; never holds an irregular chunk.

    ``value_of`` gives the value of a text, ``values_of`` those of many chunks at once.
    """

    def __init__(self, value_of, values_of, added: tuple[str, ...]):
        self.value_of, self.values_of, self.added = value_of, values_of, added

    def regular(self, chunk: str) -> bool:
        return bool(chunk) and not chunk[0].isspace() and not (self.added and chunk.startswith(self.added))

    def learn(self, texts: list[list[str]]) -> None:
        """Fills in what the chunks of some texts need, all together."""
        every = set().union(*texts)
        new = [c for c in every if c not in self]
        if len(self) + len(new) > CACHE_LIMIT:
            self.clear()
            new = every
        short = [c for c in new if len(c) <= LONGEST and self.regular(c)]
        self.update(zip(short, self.values_of(short)))

    def __missing__(self, chunk: str):
        if not self.regular(chunk):
            raise Irregular
        return self.value_of(" " + chunk)
