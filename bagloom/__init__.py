"""bagloom: analytics over bags of feature vectors, expressed as Spark DataFrame plans."""
