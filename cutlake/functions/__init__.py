"""Column helpers and the skew-safe building blocks every operator family shares."""
