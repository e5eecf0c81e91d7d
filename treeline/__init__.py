"""treeline: Spark-native analytics for aligned sequences, trees and signals."""

__version__ = "0.1.0"
