"""Queries over the driver's tables; importing this package registers them."""

from quire.plans import events, geometry, images, lists, models, numbering, packages, pagemodels, search, settings, stages, texts, validation  # noqa: F401
