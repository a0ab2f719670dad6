"""Analytics for image-capture batches and the 3-D reconstruction runs made from them."""
