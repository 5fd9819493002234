"""The analytics: measurements, scores, scenarios, published layers and their checks."""
