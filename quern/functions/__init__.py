"""Column functions and the few Python functions behind Arrow batches."""
