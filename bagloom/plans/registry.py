"""Named queries over the shared tables and the SQL that must give the same rows."""

from . import oracles, queries

FLAGSHIP = "order_eps_neighbours"
QUERIES = {f.__name__: f for f in queries.ALL}
ORACLES = dict(oracles.ALL)
