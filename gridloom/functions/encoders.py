"""Amplitude encoders: small fixed circuits as closed-form column expressions.

All gates are real, so a state is real but for one phase; the probability of a basis state is the sum
of two squares. The circuit's matrix is computed once on the driver and enters the plan as literals.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.guards import sigmoid


def rotation(theta: float) -> np.ndarray:
    return np.array([[math.cos(theta / 2), -math.sin(theta / 2)], [math.sin(theta / 2), math.cos(theta / 2)]])


def controlled_sign(qubits: int, a: int, b: int) -> np.ndarray:
    """Flips the sign of the states in which qubits a and b (0 is the highest bit) are set."""
    states = np.arange(2**qubits)
    both = (states >> (qubits - 1 - a)) & (states >> (qubits - 1 - b)) & 1
    return np.diag(1.0 - 2.0 * both)


def _each(gates: list[np.ndarray]) -> np.ndarray:
    return reduce(np.kron, gates)


def water_circuit(theta: float = math.pi / 4) -> np.ndarray:
    """Three qubits: rotations, all three pairs entangled, half rotations."""
    pairs = [controlled_sign(3, a, b) for a, b in ((0, 2), (1, 2), (0, 1))]
    return reduce(np.matmul, [_each([rotation(theta / 2)] * 3), *pairs, _each([rotation(theta)] * 3)])


def class_circuit(theta: float = math.pi / 4, qubits: int = 4) -> np.ndarray:
    """Four qubits: rotations that grow with the qubit, a chain of entanglements, rotations that shrink."""
    u = np.eye(2**qubits)
    for q in range(qubits):
        u = _each([rotation(theta * (q + 1) / qubits) if i == q else np.eye(2) for i in range(qubits)]) @ u
    for q in range(qubits - 1):
        u = controlled_sign(qubits, q, q + 1) @ u
    for q in range(qubits):
        u = _each([rotation(theta * (qubits - q) / qubits) if i == q else np.eye(2) for i in range(qubits)]) @ u
    return u


def water_amplitudes(ndwi: Column, mndwi: Column, awei: Column) -> tuple[list[Column], Column]:
    """The eight amplitudes of three indices as angles, and the phase of the first two; null indices beyond NDWI count as 0."""
    mndwi, awei = F.coalesce(mndwi, F.lit(0.0)), F.coalesce(awei, F.lit(0.0))
    angle = [(1 - ndwi) / 2 * math.pi, (1 - mndwi) / 2 * math.pi, (1 - sigmoid(awei)) * math.pi]
    parts = [(F.cos(a / 2), F.sin(a / 2)) for a in angle]
    return [parts[0][i >> 2 & 1] * parts[1][i >> 1 & 1] * parts[2][i & 1] for i in range(8)], angle[2]


def with_water_probability(df: DataFrame, ndwi: Column, mndwi: Column, awei: Column) -> DataFrame:
    """df with water (probability of the first two states) and confidence (the largest probability), from weighted indices.

    Amplitudes and probabilities are columns of their own in two steps, so each is computed once and
    everything stays in generated code.
    """
    psi, phase = water_amplitudes(ndwi, mndwi, awei)
    u = water_circuit()
    angle = F.col("__angle")
    state = [F.col(f"__s{i}") for i in range(8)]

    def probability(k: int) -> Column:
        turned = float(u[k, 0]) * state[0] + float(u[k, 1]) * state[1]
        rest = sum((float(u[k, j]) * state[j] for j in range(3, 8)), float(u[k, 2]) * state[2])
        real, imaginary = turned * F.cos(angle) + rest, turned * F.sin(angle)
        return real * real + imaginary * imaginary

    with_states = df.withColumns({"__angle": phase} | {f"__s{i}": c for i, c in enumerate(psi)})
    with_chances = with_states.withColumns({f"__p{k}": probability(k) for k in range(8)})
    chances = [F.col(f"__p{k}") for k in range(8)]
    return with_chances.withColumns({"water": chances[0] + chances[1], "confidence": F.greatest(*chances)}).drop("__angle", *[f"__s{i}" for i in range(8)], *[f"__p{i}" for i in range(8)])


def class_probabilities(latent: Column, classes: int = 8) -> Column:
    """Probabilities of `classes` classes (two states each) from an array of up to 16 latent values; all zeros count as the first state."""
    u = class_circuit()
    padded = F.slice(F.concat(F.transform(latent, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), 16)), 1, 16)
    norm = F.sqrt(F.aggregate(padded, F.lit(0.0), lambda s, x: s + x * x))
    matrix = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in u])

    def born(v: Column) -> Column:
        return F.transform(matrix, lambda row: F.pow(F.aggregate(F.zip_with(row, v, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), F.lit(2.0)))

    unit = F.when(norm > 1e-10, F.transform(padded, lambda x: x / norm)).otherwise(F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(16)]))
    return F.transform(F.array(born(unit)), lambda p: F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: p[2 * c] + p[2 * c + 1]))[0]
