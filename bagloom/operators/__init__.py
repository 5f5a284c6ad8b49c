"""Distance, join, clustering, scaling, evaluation and sampling operators over bags."""
