"""Operators that keep no state and therefore also take a streaming DataFrame.

Batch is what the library is built for; no operator here waits for other rows.
``laplace_noise`` needs ``bounds`` for all its columns on a stream.
"""

from duskveil.operators.charts import numeric_cells
from duskveil.operators.masks import mask_share, mask_tail, mask_word_tails, suppress_text
from duskveil.operators.perturb import laplace_noise, shift_dates

STATELESS = (
    mask_share, mask_tail, mask_word_tails, suppress_text, numeric_cells, laplace_noise, shift_dates,
)
