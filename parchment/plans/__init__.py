"""The registered queries; review, verdicts and structure add theirs to the catalog."""

from parchment.plans import catalog, details, intake, review, structure, verdicts  # noqa: F401
