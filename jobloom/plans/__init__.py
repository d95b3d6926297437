"""The registered queries over the driver's tables."""
