"""Special functions on numpy arrays of positive numbers."""

from __future__ import annotations

import numpy as np


def _raised(x: np.ndarray) -> np.ndarray:
    return np.where(x < 6, x + 6, x)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of the logarithm of the gamma function, by its asymptotic series above 6."""
    x = np.asarray(x, np.float64)
    low = sum(np.where(x < 6, 1 / (x + i), 0.0) for i in range(6))
    y = _raised(x)
    r = 1 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (5 / 660 - r * 691 / 32760)))))
    return np.log(y) - 0.5 / y - series - low


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function, by Stirling's series above 6."""
    x = np.asarray(x, np.float64)
    low = np.log(np.where(x < 6, x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5), 1.0))
    y = _raised(x)
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - low
