"""The registered queries."""

SLOWEST = "revenue_models"  # fits 150 trees; listed last so that the rest is not kept waiting


def all_queries():
    from tillscope.plans import models, reports, statistics

    found = [*reports.QUERIES, *statistics.QUERIES, *models.QUERIES]
    return sorted(found, key=lambda q: q.name == SLOWEST)
