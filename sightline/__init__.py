"""sightline: timed detections, tracks, identities and appearance reports on Spark."""
