"""lumafold: PySpark-native analytics over sampling lattices, ordered event logs and signals."""

__version__ = "0.1.0"
