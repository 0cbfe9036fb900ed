"""Run parameters with the values of the original analysis as defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Inclusion:
    """Cut-offs of the vulnerable group; meant to be tuned from the bin tables."""

    loneliness_above: int = 8
    control_below: int = 23
    anxiety_above: int = 20
    poor_health: int = 3
    issues_above: int = 4


@dataclass(frozen=True)
class Segmentation:
    k: int = 9
    perplexity: int = 40
    theta: float = 0.3
    tsne_iterations: int = 1000
    neighbours: int = 15
    umap_iterations: int = 200
    eps: float = 0.4
    min_points: int = 4
    outlier_threshold: float | str = 49.3  # or "last_bin"
    min_correlation: float = 0.35
    chains: int = 5
    impute_iterations: int = 10
    impute_extra_iterations: int = 15
    kmeans_iterations: int = 1000
    medoid_iterations: int = 50
    seed: int = 500
    inclusion: Inclusion = field(default_factory=Inclusion)


@dataclass(frozen=True)
class Classification:
    train_share: float = 0.6
    components: int = 10
    trees: int = 500
    svm_gamma: float = 0.1
    svm_cost: float = 10.0
    fourier_features: int = 200
    seed: int = 123
    min_correlation: float = 0.3
    chains: int = 5
    impute_iterations: int = 2
