"""A finite transducer run over a long stream of symbols in parallel.

The stream is cut into chunks. Each chunk becomes the function from the state before it to the
state after it (one entry per state); the functions are composed by a parallel prefix scan, which
gives every chunk its true first state; a last pass over the chunks yields the outputs. All chunks
advance together, so the passes are array operations.
"""

from __future__ import annotations

import numpy as np


class Transducer:
    """step[symbol, state] is the next state, out[symbol, state] whether a boundary is put out. Symbol 0 does nothing."""

    def __init__(self, step: np.ndarray, out: np.ndarray, chunk: int = 64):
        self.step, self.out, self.chunk, self.states = step.astype(np.uint8), out, chunk, step.shape[1]

    def run(self, symbols: np.ndarray, first: int = 0) -> np.ndarray:
        """Whether a boundary is put out at each symbol."""
        n, c, s = len(symbols), self.chunk, self.states
        if not n:
            return np.zeros(0, bool)
        rows = -(-n // c)
        grid = np.zeros(rows * c, np.intp)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(rows, c).T)
        flat_step, flat_out = self.step.ravel(), self.out.ravel()
        function = np.tile(np.arange(s, dtype=np.uint8), (rows, 1))
        for sym in grid:
            function = flat_step[(sym * s)[:, None] + function]
        function = scan(function)
        state = np.empty(rows, np.intp)
        state[0] = first
        state[1:] = function[:-1, first]
        put = np.empty((c, rows), bool)
        for i, sym in enumerate(grid):
            at = sym * s + state
            put[i] = flat_out[at]
            state = flat_step[at].astype(np.intp)
        return put.T.reshape(-1)[:n]

    def run_one_by_one(self, symbols: np.ndarray, first: int = 0) -> np.ndarray:
        """The same, symbol after symbol; the tests compare both."""
        state, put = first, []
        for x in symbols:
            put.append(bool(self.out[x, state]))
            state = int(self.step[x, state])
        return np.array(put, bool)


def scan(functions: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state functions under composition: row i becomes f_i o ... o f_0."""
    done = functions
    width = 1
    while width < len(done):
        merged = done.copy()
        merged[width:] = np.take_along_axis(done[width:], done[:-width].astype(np.intp), 1)
        done, width = merged, width * 2
    return done
