"""Reading and writing the stored inputs and results."""
