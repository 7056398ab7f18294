"""Column functions: cell coercion, text transforms, value detectors and similarity keys."""
