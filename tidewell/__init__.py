"""Target-decoy scored signal analytics as PySpark DataFrame operators."""
