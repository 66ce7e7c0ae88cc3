"""Registered queries; importing the package registers all of them."""

from tamarack.plans import answers, audits, datasets, feedback, metrics, profiles, projections, ranking, recommend, registry, reports  # noqa: F401
